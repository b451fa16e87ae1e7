import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import lists, text, vectors
from graphloom.operators import extract
from graphloom.operators.budget import pack


def column(spark, values, fn, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(fn(F.col("v"))).collect()]


def test_problem_ids(spark):
    values = ["P1001 A+B", "CF12A x", "P1001", "abc d", "123 x", "", None]
    assert column(spark, values, text.problem_id) == ["P1001", "CF12A", None, None, None, None, None]
    assert column(spark, ["P1001", "cf12a", "X1"], text.platform) == ["Luogu", "Codeforces", "未知题库"]


def test_normalized_names(spark):
    values = ["<p>图 论</p>", "“图论”", "'x'", '"a"b"', "Ｂ１", "12", "1.23", "123", "图 a", "《书》", "x<br/>y", None]
    assert column(spark, values, text.normalized_name) == ["图论", "图论", "x", '"a"b"', "B1", "", "", "123", "图a", "书", "xy", None]
    assert column(spark, ["图“论”", "图'论"], lambda c: text.normalized_name(c, True)) == ["图论", "图论"]


@pytest.mark.parametrize("damaged", ["<|##|>", "<|#||#|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<#>", "<#|>", "<|#>", "<X#|>", "<|#X>", "<|#|", "<|#||", "<|#:", "<||#>", "|#|>", "||#||"])
def test_delimiters_are_mended(spark, damaged):
    assert column(spark, [f"a{damaged}b"], text.mend_delimiters) == ["a<|#|>b"]


def test_keywords_and_types(spark):
    assert column(spark, ["IS_A， foo,PART_OF"], text.known_keywords) == [["IS_A", "PART_OF"]]
    assert column(spark, ["IS_A,foo"], lambda c: text.with_unknown_keywords(c, F.lit("d"))) == ["d [未识别关键词: foo]"]
    assert column(spark, ["foo, bar"], lambda c: text.with_unknown_keywords(c, F.lit(""))) == ["[未识别关键词: foo] [未识别关键词: bar]"]
    assert column(spark, ["x" * 300, " a "], text.summary) == ["x" * 250 + "...", "a"]


def test_list_operations(spark):
    df = spark.createDataFrame([(["c1", "c2", "c3"], ["c1", "c2"], ["c2", "c4"])], "e array<string>, o array<string>, n array<string>")
    row = df.select(lists.apply_delta(F.col("e"), F.col("o"), F.col("n")).alias("d"), lists.union(F.col("e"), F.col("n")).alias("u"), lists.cap(F.col("e"), 2).alias("last"), lists.cap(F.col("e"), 2, newest=False).alias("first"), lists.cap(F.col("e"), 0).alias("none"), lists.cap(F.col("e"), 9).alias("all")).first()
    assert (row.d, row.u, row.last, row.first, row.none, row.all) == (["c2", "c3", "c4"], ["c1", "c2", "c3", "c4"], ["c2", "c3"], ["c1", "c2"], [], ["c1", "c2", "c3"])


def test_vector_codec_and_columns(spark):
    df = spark.createDataFrame([(1, [1.0, -2.5])], "id int, embedding array<float>")
    back = df.select("id", vectors.encode_float32("embedding").alias("code")).select(vectors.decode_float32("code").alias("v")).first()
    assert back.v == [1.0, -2.5]
    assert vectors.without_vectors(df.withColumn("s", F.struct(F.lit(1).alias("a"), F.lit(2).alias("name_vector")))).schema.simpleString() == "struct<id:int,s:struct<a:int>>"
    assert spark.createDataFrame([([0.0],)], "v array<float>").select(vectors.cosine(F.col("v"), F.col("v"))).first()[0] is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=30), st.integers(1, 100))
def test_packing(tokens, limit):
    parts = [(n, f"p{i}") for i, n in enumerate(tokens)]
    groups = pack(parts, limit)
    assert [p for g in groups for p in g] == [p for _, p in parts]
    size = dict((p, n) for n, p in parts)
    assert all(len(g) <= 2 or sum(size[p] for p in g) <= limit for g in groups)


def test_damaged_markers(spark):
    forms = ["<|##|>", "<|#||#|>", "<|#|||#|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<X|#|Y>", "<||#||>", "<#>", "<#|>", "<|#>", "<X#|>", "<|#X>", "<|#|", "<|#||", "<|#:", "<||#>", "<||", "|#|>", "<|#|>|", "||#||", "<|#|>"]
    whole = ["a|b", "#", "<p>", "a < b > c", "##", "|#", "#|", "<>", "a#b", "<X#Y>", "<b>|</b>"]
    rows = spark.createDataFrame([(f"a{x}b", True) for x in forms] + [(x, False) for x in whole] + [(None, False)], "s string, mended boolean")
    for r in rows.select("*", text.mend_delimiters(rows.s).alias("out")).collect():
        assert r.out == ("a<|#|>b" if r.mended else r.s), r


def test_marked_bodies_are_those_of_a_search_by_characters(spark):
    """Bodies by lines against a look-ahead at each character, and marks with and without a look at the first one."""
    g = random.Random(3)
    bits = ["entity<|#|>", "relation<|#|>", "\n", "\n", "\r", "\r\n", "\x85", "\u2028", "a", "b<|#|>c", " ", "<|", "|>", "#", "<#|>"]
    texts = [(i, "".join(g.choice(bits) for _ in range(g.randrange(12)))) for i in range(3000)] + [(-1, None)]
    df = spark.createDataFrame(texts, "i int, response string")
    for kind in ("entity", "relation"):
        whole = F.regexp_extract_all("response", F.lit(rf"(?s){kind}<\|#\|>(.*?)(?=\n(?:entity|relation)<\|#\|>|$)"), F.lit(1))
        assert not df.where(~whole.eqNullSafe(extract._bodies(F.col("response"), kind))).count()
    plain = text.DAMAGED.removeprefix(r"(?=[<\|])")
    assert plain != text.DAMAGED
    assert not df.where(~F.regexp_replace("response", plain, "<|#|>").eqNullSafe(text.mend_delimiters(F.col("response")))).count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fields_and_names_are_made_once(spark):
    rows = spark.createDataFrame([(1, 2, "f", "c", "entity<|#|>a<|#|>b<|#|>c<|#|>d")], "doc_id int, pos int, file_path string, chunk_id string, response string")
    assert "transform(split" not in plan_of(extract.entities(rows))
    for df in extract.library_records(rows):
        # a cleaned name closes with this pattern; entities have three, relations four
        assert plan_of(df).count("^[0-9]{1,2}$") <= 4 and plan_of(df).count("<|#|>, 1), \\Q<|#|>\\E") <= 2
