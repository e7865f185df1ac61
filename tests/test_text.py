"""Column functions: native text operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from quire.functions import arrow
from quire.functions import text as t


def one(spark, expr, text="x", **more):
    df = spark.createDataFrame([(text,)], "text string")
    for name, value in more.items():
        df = df.withColumn(name, F.array(*map(F.lit, value)).cast("array<string>"))
    return df.select(expr.alias("r")).first().r




@pytest.fixture(autouse=True, scope="module")
def _column(spark):
    """Columns need a session."""
    global X
    X = F.col("text")


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, ""), ("", ""), ("éa", "éa"), ("a\x00\x07b", "ab"), ("a \t  b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("  a  ", "a"), ("Å", "Å")],
)
def test_normalize(spark, text, want):
    assert one(spark, arrow.normalize(X), text) == want


def test_tokens_keep_underscores_and_split_at_marks(spark):
    assert one(spark, t.tokens(X), "It's a_b Été 3,5 \U0001d7ce \U0001f642") == ["it", "s", "a_b", "été", "3", "5", "\U0001d7ce"]
    assert one(spark, t.content_tokens(X), "The cat is in a Box x") == ["cat", "box"]
    assert one(spark, t.tokens(X), None) == []


def test_sentences(spark):
    assert one(spark, t.sentences(X), "One two three. One two three four! no ? Four words are here") == ["One two three four!", "Four words are here"]
    text = "Seven words are in this one sentence.\nseven words are in this one SENTENCE.\nshort one."
    assert one(spark, t.quiz_sentences(X), text) == ["Seven words are in this one sentence."]
    assert one(spark, t.average_sentence_length(X), "a b c. d e f g.") == 3.5
    assert one(spark, t.average_sentence_length(X), "") is None


@pytest.mark.parametrize(("text", "want"), [("x", "Unknown"), ("This is an English sentence about words.", "English"), ("Đây là một câu tiếng Việt khá dài để thử.", "Vietnamese"), (None, "Unknown")])
def test_language(spark, text, want):
    assert one(spark, t.language(X), text) == want


@pytest.mark.parametrize("line", ["Trang 12", "Page 3 of 10", "tr. 5", "p.7", "3/10", "3 of 10", "12", "- 12 -", "[12]", " (4) "])
def test_page_numbers(spark, line):
    assert one(spark, t.is_page_number(X), line)


@pytest.mark.parametrize("line", ["", None, "1234", "Chapter 12", "12 apples", "page", "Trang 12345", "x" * 30])
def test_no_page_numbers(spark, line):
    assert not one(spark, t.is_page_number(X), line)


def test_strict_page_numbers(spark):
    assert not one(spark, t.is_page_number(X, True), "12") and one(spark, t.is_page_number(X, True), "Page 12")
    paras = ["12", "text", "a\nPage 3\nb", "7\nx", "Trang 1\n2/3"]
    assert one(spark, t.drop_page_numbers(F.col("p")), p=paras) == ["text", "a\nb", "7\nx"]


@pytest.mark.parametrize("line", ["y = Wx + b", "E = mc^2", "∑ x_i", "\\frac{a}{b}", "α + β"])
def test_formula_lines(spark, line):
    assert one(spark, t.looks_like_formula(X), line)


@pytest.mark.parametrize("line", ["np.ones(3)", "import os", "x = 'a'", "f(a=1)", "a[i] = 3", "p = {1}", "run()", "s = r**2"])
def test_code_lines(spark, line):
    assert one(spark, t.looks_like_code(X), line) and not one(spark, t.looks_like_formula(X), line)


def test_no_formula_lines(spark):
    for line in ("", "ab", "plain words only here", "where the value of x = 3 is known", "=" * 161):
        assert not one(spark, t.looks_like_formula(X), line)
    assert one(spark, t.looks_like_formula(X), "=" * 160)


def test_units(spark):
    assert one(spark, t.units(X), "16 GB, 16GB 3.5 GHz 1,5 ms 5 MBps 3.GB v2 GB 20°C 7 % 9FLOP") == ["16 GB", "3.5 GHz", "1,5 ms", "20 °C", "7 %", "9 FLOP"]


def test_phrases(spark):
    assert one(spark, t.capitalized_phrases(X), "Laravel Sail 3, (Visual) Studio. Single word. New Trong Day Two") == ["Laravel Sail Visual Studio", "Day Two"]
    got = one(spark, t.terminology(X), "PHP uses makeController and app/Http:x. Visual Studio")
    assert got == ["Http", "PHP", "Visual Studio", "app/Http:x", "makeController"]


def test_clean_terms(spark):
    f = lambda terms, text="": one(spark, t.clean_terms(F.col("terms"), X), text, terms=terms)
    assert f(["BACKLOG", "Backlog", "backlog"]) == ["Backlog"]
    assert f(["PROCESSING"]) == ["Processing"]
    assert f(["API", "AI"]) == ["AI", "API"]
    assert f(["code", "Design"]) == [] and f(["one two three four five six"]) == []
    assert f(["Scrum"], "Scrum is here. Scrum again, scrum Scrum") == ["Scrum"]
    assert f(["Scrum"], "Scrum once") == [] and f([]) == []


def test_merge_terms(spark):
    assert one(spark, t.merge_terms(F.col("a"), F.col("b")), a=["Beta", "AI"], b=["beta", "alpha", "ai"]) == ["AI", "alpha", "Beta"]


def test_undefined(spark):
    text = "GPU and GPU, AI AI, CPU once, non-GPU, XGPU TOOLONGG TOOLONGG"
    assert one(spark, t.undefined_abbreviations(X, F.col("d")), text, d=["AI"]) == ["GPU"]


def test_small_ones(spark):
    assert one(spark, t.preview(X), "*bold*  text") == "bold text"
    assert one(spark, t.preview(X), "a" * 200) == "a" * 159 + "…"
    assert one(spark, t.stem(X), "/d/my_file-two.tar.pdf") == "my file two.tar" and one(spark, t.stem(X), "") == "không tên"
    assert one(spark, t.extension(X), "d.e/File.TXT") == ".txt" and one(spark, t.extension(X), ".hidden") == ""
    assert one(spark, t.reading_minutes(X), "") == 1 and one(spark, t.reading_minutes(X), "w " * 500) == 2
    assert one(spark, t.clean_ocr_noise(X), "a | b _ c ^ d") == "a b c d"
    assert one(spark, t.clean_for_speech(X), "# T\n- a\n• b\n\n\n\n`c`") == "T\na\nb\n\nc"
    assert one(spark, t.signature(X), "Trang  12\tA") == "trang # a"
    assert len(one(spark, t.sample_parts(X), "x" * 20000)) == 12000 + 6
    assert one(spark, t.safe_name(X), "Text Rank+é") == "Text_Rank_é"
    assert one(spark, t.candidate_terms(F.col("p")), p=["ab", "Graph", "graph", "code", "123", "a/b", "one two three four five", "Neural  Net"]) == ["Graph", "Neural Net"]
    assert one(spark, t.top_concepts(X, F.col("p")), "b a b. ab c a b", p=["a", "B", "c", "z"]) == ["B", "a", "c"]


def test_guide(spark):
    empty = F.array().cast("array<struct<abbr:string,long:string>>")
    assert one(spark, t.glossary_guide(F.col("a"), empty, F.col("b")), a=[], b=[]) == ""
    got = one(spark, t.glossary_guide(F.col("a"), F.array(F.struct(F.lit("AI").alias("abbr"), F.lit("artificial").alias("long"))), F.col("b")), a=["x"] * 30, b=["y=1"])
    assert got.count("x") == 25 and "AI = artificial" in got and "y=1" in got
