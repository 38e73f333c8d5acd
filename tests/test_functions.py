import pytest
from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("getUserProfile", "getUserProfile get user profile"),
        ("load_config_file", "load_config_file load config file"),
        ("HTTPSConnection", "HTTPSConnection https connection"),
        ("hello world", "hello world"),
        ("fn do", "fn do"),
        ("readFile readFile", "readFile readFile read file read file"),
        ("returnValue", "returnValue value"),
        ("", ""),
    ],
)
def test_split_identifiers(spark, text, want):
    assert one(spark, X.split_identifiers(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("parseHTTPHeader", ["header", "http", "parse"]),
        ("fn db io", ["db", "fn", "io"]),
        ("a b x1", ["a", "b", "x1"]),
        ("Été é", ["é"]),  # bytes, not characters, are counted
    ],
)
def test_terms(spark, text, want):
    got = one(spark, X.terms(F.col("t")), t=text)
    assert got == sorted(set(got))
    assert got == want


def test_query_terms_and_code(spark):
    assert one(spark, X.query_terms(F.col("t")), t="xy db getUser") == ["db", "get", "user"]
    assert one(spark, X.is_code_query(F.col("t")), t="getUser") is True
    assert one(spark, X.is_code_query(F.col("t")), t="Get user") is False


def test_expand_query(spark):
    table = {"auth": ["login", "token"], "login": ["auth", "session"]}
    assert one(spark, X.expand_query(F.col("t"), table), t="auth flow") == "auth flow login token"
    assert one(spark, X.expand_query(F.col("t"), table), t="author login") == "author login session"  # author holds auth
    assert one(spark, X.expand_query(F.col("t"), table), t="nothing known") == "nothing known"


def test_lines_and_tokens(spark):
    assert one(spark, X.lines(F.col("t")), t="a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(spark, X.estimated_tokens(F.col("t")), t="é" * 10) == 5
    assert one(spark, X.preview(F.col("t"), 2), t="\n a\n \nb\nc") == [" a", "b"]
    assert one(spark, X.extension(F.col("t")), t="a/b.Tar.GZ") == ".gz"
    assert one(spark, X.extension(F.col("t")), t="a/.hidden") == ""


def test_scope_keeps_siblings_out(spark):
    files = spark.createDataFrame([("src/cli/mod.rs",), ("src/cli_utils/helper.rs",), ("src/cli",)], "f string")
    assert {r["f"] for r in files.filter(P.in_scope(F.col("f"), "src/cli/")).collect()} == {"src/cli/mod.rs", "src/cli"}
    assert files.filter(P.in_scope(F.col("f"), ".")).count() == 3


@pytest.mark.parametrize(("types", "want"), [("py", {"a.py", "b.pyi"}), (" TS ,foo", {"c.tsx", "d.foo"}), (None, {"a.py", "b.pyi", "c.tsx", "d.foo"})])
def test_types(spark, types, want):
    files = spark.createDataFrame([("a.py",), ("b.pyi",), ("c.tsx",), ("d.foo",)], "f string")
    assert {r["f"] for r in files.filter(P.of_types(F.col("f"), types)).collect()} == want


def test_exclude_is_literal_and_globs_are_globs(spark):
    files = spark.createDataFrame([("tests/a.py",), ("src/tests/b.py",), ("x/tests/*",)], "f string")
    assert files.filter(P.excluded(F.col("f"), ["tests/*"])).count() == 1
    assert {r["f"] for r in files.filter(P.matches_glob(F.col("f"), ["tests/*"])).collect()} == {"tests/a.py"}
    assert files.filter(P.matches_glob(F.col("f"), ["**/b.py"])).count() == 1


def test_names_and_regex(spark):
    for path, want in [("a/.h", True), ("a-lock.json", True), ("x.SVG", True), ("x.py", False), ("__init__.py", False), ("Makefile", False)]:
        assert one(spark, P.skipped_name(F.col("p")), p=path) is want
    assert one(spark, P.has_name(F.col("n"), "login"), n="User.login") is True
    assert one(spark, P.has_name(F.col("n"), "login"), n="xlogin") is False
    with pytest.raises(ValueError):
        P.matches(F.col("a"), F.col("b"), "(")
    with pytest.raises(ValueError):
        P.matches(F.col("a"), F.col("b"), "a(?=b)")
    assert one(spark, P.is_text(F.col("c")), c="a\0b") is False
