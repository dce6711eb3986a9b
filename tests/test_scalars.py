import pytest
from pyspark.sql import functions as F

from sourceloom.functions import scalars as S


def column_values(spark, inputs, expression, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_languages(spark):
    names = ["Dockerfile", "CONTAINERFILE", "Dockerfile.prod", "a.py", "b.PYI", "c.tsx", "d.mjs", "e.yml", "f.markdown", "g.rs", ".py", "noext"]
    assert column_values(spark, names, S.detect_language) == [
        "Dockerfile", "Dockerfile", "Dockerfile", "Python", "Python", "TypeScript", "JavaScript", "YAML", "Markdown", "Unknown", "Unknown", "Unknown"]


def test_suffix_and_folder(spark):
    assert column_values(spark, [".env", "a.tar.gz", "x.", "y", "Z.PY"], S.suffix) == ["", ".gz", "", "", ".py"]
    assert column_values(spark, ["a.py", "a/b.py", "a/b/c.py"], S.folder_path) == ["", "a", "a/b"]


def test_ignored_directories_match_folders_only(spark):
    paths = ["node_modules/x.js", "src/build/x.py", "src/build", "a/.git/config", "venv.py", "rebuild/x"]
    assert column_values(spark, paths, S.in_ignored_directory) == [True, True, False, True, False, False]


def test_count_lines_follows_splitlines(spark):
    texts = ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "a\rb", "a\x0bb\x0cc\x1cd\x85e f", "\n\n", "a\n\r", "x "]
    assert column_values(spark, texts, S.count_lines) == [len(t.splitlines()) for t in texts]


def test_module_names(spark):
    paths = ["a/b.py", "a/__init__.py", "__init__.py", "x.pyi", "a/b/c.test.py"]
    assert column_values(spark, paths, S.module_name) == ["a.b", "a", "__init__", "x", "a.b.c.test"]
    assert column_values(spark, ["a.b", "a", "a.b.c"], S.parent_package) == ["a", None, "a.b"]
    assert column_values(spark, ["a.b", "", "os"], S.top_package) == ["a", "unknown", "os"]


def test_visibility_and_types(spark):
    assert column_values(spark, ["__x", "__x__", "_x", "x"], S.visibility) == ["private", "protected", "protected", "public"]
    assert column_values(spark, ["'a.B'", "List[int]", "m.Foo[bar.Baz]", "X"], S.simple_type_name) == ["B", "List", "Foo", "X"]


def test_vocabulary(spark):
    assert column_values(spark, ["file", "env_var", "mystery_type"], S.entity_label) == ["File", "EnvironmentVariable", "Unknown"]
    assert column_values(spark, ["imports", "instantiates", "exports", "custom_rel"], S.edge_type) == ["IMPORTS", "CREATES", "EXPOSES", "CUSTOM_REL"]
    assert S.known_edge_types(None) == []
    assert set(S.known_edge_types(["imports", "CALLS", "drop"])) == {"IMPORTS", "CALLS"}
    assert S.clamp_depth(15) == 15 and S.clamp_depth(0) == 1 and S.clean_direction("sideways") == "outgoing"


@pytest.mark.parametrize("url, branch, bad", [
    ("https://host/x.git", "main", False), ("  http://host:8080/x ", "release/2.4", False), ("ftp://host/x", "main", True),
    ("host/x", "main", True), ("https://user@host/x", "main", True), ("https://u:p@host/x", "main", True),
    ("https://LOCALHOST/x", "main", True), ("http://[::1]:80/x", "main", True), ("https://host/x", "a..b", True),
    ("https://host/x", "a//b", True), ("https://host/x", "sp ace", True)])
def test_git_sources(spark, url, branch, bad):
    row = spark.createDataFrame([(url, branch)], "u string, b string").select(S.git_source_error(F.col("u"), F.col("b")).alias("e")).first()
    assert (row["e"] is not None) == bad


def test_names_and_tags(spark):
    assert column_values(spark, ["  Core   API ", "ab", "-bad-", "ok.name_1"], lambda x: S.name_error(x).isNull()) == [True, False, False, True]
    rows = spark.createDataFrame([(["Python ", "python", "api"],), (["bad tag"],), ([f"t{i}" for i in range(21)],)], "t array<string>")
    got = rows.select(S.normalized_tags(F.col("t")), S.tags_error(F.col("t"))).collect()
    assert got[0][0] == ["python", "api"] and got[0][1] is None and got[1][1] and got[2][1]
