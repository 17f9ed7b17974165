"""Scalar rules on written cases."""

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import jsoneval, locations, names, paths, texts, tokenize


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("glob", "regex"),
    [("*.cpp", r"[^/]*\.cpp"), ("**.h", r".*\.h"), ("^src/a/**.{cpp,h}$", r"^src/a/.*\.(cpp|h)$"), ("a?c", "a.c"), ("f(x)|y", r"f\(x\)\|y"), ("a,b", "a,b"), ("", "")],
)
def test_glob(glob, regex):
    assert paths.glob_to_regex(glob) == regex


def test_paths(spark):
    assert one(spark, paths.mangle(F.lit("path/foo.h"))) == "path/foo@2Eh"
    assert one(spark, paths.mangle(F.lit("sub/h@with,many^odd~chars.h"))) == "sub/h@40with@2Cmany@5Eodd@7Echars@2Eh"
    assert one(spark, paths.mangle(F.lit("é"))) == "@C3"
    assert one(spark, paths.dirname(F.lit("a/b/c.h"))) == "a/b"
    assert one(spark, paths.dirname(F.lit("c.h"))) == ""
    assert one(spark, paths.extension(F.lit("a.b/c"))) == ""
    rows = [r.p for r in spark.createDataFrame([("a10.h",), ("a9.h",), ("B1.h",)], "p string").orderBy(paths.natural_key(F.col("p"))).collect()]
    assert rows == ["a9.h", "a10.h", "B1.h"]
    assert paths.valid_path("/a/b") == "a/b"
    with pytest.raises(ValueError):
        paths.valid_path("a/../b")


def test_kinds_and_tags(spark):
    kinds = [paths.PathKind("normal", 0), paths.PathKind("third", 1, path_prefixes=["tp/"]), paths.PathKind("test", 2, dir_names=["tests"], dir_suffixes=["testing"]), paths.PathKind("gen", 3, path_prefixes=["out/"])]
    cases = {"a/b.c": "normal", "tp/tests/x": "third", "a/tests/x": "test", "a/mytesting/x": "test", "out/tests/x": "test", "out/x": "gen", "tests": "normal"}
    got = {r.p: r.k for r in spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.path_kind(F.col("p"), kinds).alias("k")).collect()}
    assert got == cases
    rules = paths.ignore_rules(["# note", "", "a/", "!a/keep/**", "\\!odd"])
    want = {"a/x": True, "a/keep/x": False, "b": False, "!odd": True}
    got = {r.p: r.t for r in spark.createDataFrame([(p,) for p in want], "p string").select("p", paths.last_match(F.col("p"), rules).alias("t")).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("name", "sym", "parts"),
    [
        ("foo/bar/Baz.h", "FILE_foo", ["foo/", "bar/", "Baz.h"]),
        ("ns::inner::Thing", "T_x", ["ns", "inner", "Thing"]),
        ("Ptr::operator->", "_Z1", ["Ptr", "operator->"]),
        ("Box<ns::Uniq<char[], X::Y>>::Read", "T_x", ["Box<ns::Uniq<char[], X::Y>>", "Read"]),
        ("Arr<std::pair<u8, u8>, 1 << sizeof(K) * 8>::Do", "T_x", ["Arr<std::pair<u8, u8>, 1 << sizeof(K) * 8>", "Do"]),
        ("a:b", "T_x", ["a)b"]),
        ("", "T_x", []),
    ],
)
def test_segments(spark, name, sym, parts):
    assert names.split_name(name, sym)[0] == parts
    assert one(spark, names.segments(F.lit(name), F.lit(sym))) == parts


def test_suffixes(spark):
    assert one(spark, names.suffixes(F.array(F.lit("a"), F.lit("b"), F.lit("c")), "::")) == ["a::b::c", "b::c", "c"]
    assert names.mangled(["outer", "Thing"]) == "_ZN5outer5ThingE"


RULES = names.TypeRules(pointers={"Strong": ("strong", 0), "Uniq": ("unique", 0), "Table": ("unique", 1), "May": ("contains", 0)}, decorators={"Atomic": ["atomic"]}, containers={"Arr"}, variants={"Either"}, values={"Str"}, nothing={"Nil"})


@pytest.mark.parametrize(
    ("text", "found", "labels"),
    [
        ("_Bool", [], []),
        ("class Strong<class outer::Actual>", [("strong", "outer::Actual")], []),
        ("Uniq<class Dog, X::Free>", [("unique", "Dog")], []),
        ("Auto<Strong<class Sel>, 1>", [("strong", "Sel")], []),
        ("NotNull<Strong<class Con> >", [("strong", "Con")], []),
        ("union Info::(anonymous at a.cpp:1:2)", [], []),
        ("class Table<class Key, class Reg>", [("unique", "Reg")], []),
        ("Arr<class Ex *>", [("raw", "Ex")], []),
        ("const struct ns::Req", [("contains", "ns::Req")], []),
        ("class Str<char16_t>", [], []),
        ("class Either<struct Nil, class Strong<class Win>, class ns::Work *>", [("strong", "Win"), ("raw", "ns::Work")], []),
        ("class Atomic<class ns::Work *>", [("raw", "ns::Work")], ["atomic"]),
        ("class May<class Str<char16_t> >", [], []),
        ("Arr2<std::pair<u8, u8>, 1 << sizeof(K) * 8>", [], []),
    ],
)
def test_types(text, found, labels):
    assert names.pointees(text, RULES) == (found, labels)


def test_locations(spark):
    assert tuple(one(spark, locations.parse_location(F.lit("00012:4-9")))) == (12, 4, 9)
    assert tuple(one(spark, locations.parse_location(F.lit("2:5")))) == (2, 5, 5)
    assert one(spark, locations.parse_location(F.lit("x"))) is None
    assert one(spark, locations.format_location(F.lit(12), F.lit(4), F.lit(9))) == "00012:4-9"
    assert one(spark, locations.parse_line_range(F.lit("0-0"))) is None
    spans = spark.createDataFrame([("3:1-4:2",), ("2:9-2:10",), (None,)], "s string").select(locations.parse_span(F.col("s")).alias("s"))
    assert tuple(spans.agg(locations.union_spans(F.col("s")).alias("u")).first().u) == (2, 9, 4, 2)


def test_texts(spark):
    assert one(spark, texts.describe(F.lit("a.c"), F.lit("/* License */ /** real\n * text */"))) == "real\n text "
    assert one(spark, texts.describe(F.lit("a.py"), F.lit('"""  doc """'))) == "doc "
    assert one(spark, texts.describe(F.lit("m.rs"), F.lit("//! one\n//! two\nfn x(){}"))) == " one\n two"
    assert one(spark, texts.describe(F.lit("docs/ReadMe.md"), F.lit("\n \nHello\n"))) == "Hello"
    assert one(spark, texts.describe(F.lit("a.bin"), F.lit("x"))) is None
    assert ">bUg 12345</a>" in one(spark, texts.link_issues(F.lit("see bUg 12345")))
    parts = one(spark, texts.commit_parts(F.lit("Head\n\nbody\nDifferential Revision: D7\nPull request: 9")))
    assert (parts.header, parts.review, parts.pull) == ("Head", "D7", "9")
    code = one(spark, texts.error_code(F.lit(0x804B0001)))
    assert tuple(code) == (True, 6, 1)


def test_json(spark):
    doc = F.lit('{"a": [{"b": 1}, {"b": 2}], "c": {"x": 1, "y": 2}}')
    assert one(spark, jsoneval.evaluate(doc, "/a/1/b")) == "2"
    assert one(spark, jsoneval.evaluate(doc, "/z", "none")) == "none"
    assert one(spark, jsoneval.evaluate(doc, "/a", aggregation="length")) == "2"
    assert one(spark, jsoneval.evaluate(doc, "/c", aggregation="length")) == "2"
    assert list(jsoneval.walk("dirs-are-dicts", {"d": {"f": 1}, "g": 2})) == [("d/f", 1), ("g", 2)]
    assert list(jsoneval.walk("files-are-keys", {"d": {"f": 1}})) == [("d/f", 1)]
    with pytest.raises(ValueError):
        list(jsoneval.walk("other", {}))


@pytest.mark.parametrize("path", ["a.cpp", "a.py", "a.css", "a.html", "a.yaml", "a.txt"])
def test_tokens_cover_text(path):
    text = "int x = 'a'; // note\n# c\n<b q=\"1\">t</b>\nkey: v\n/* un"
    tokens = list(tokenize.tokenize(text, path))
    for t in tokens:
        assert text[t.start : t.start + len(t.text)] == t.text
    covered = sum(len(t.text) for t in tokens if not t.text.isspace())
    assert covered >= sum(not c.isspace() for c in text)


def test_outline():
    assert tokenize.outline("class A:\n    def f(self):\n        pass\n", "x.py") == [(1, "class", "A"), (2, "def", "f")]
