"""Operators on frames: domains, layout, measures, statistics, quiz, library, models."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quire.functions import values as v
from quire.operators import domain, layout, measures, ml, models, quiz, rank, stats, store

LEX = {
    "Alpha": ["neural network", "network", "ci/cd", "deep"],
    "Beta": ["query", "inner join", "join"],
    "Gamma": ["query", "a a"],
}


@pytest.fixture(scope="module")
def lex(spark):
    return domain.lexicon(spark, LEX, {"Alpha": "Science"})


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_scores(spark, lex):
    d = docs(spark, "A Neural Network, network; networks CI/CD ci/cd. neural  network", "Query the inner join. joins", "a a a", "nothing", "", None)
    got = {(r.doc_id, r.domain): r.score for r in domain.score_domains(d, lex).collect()}
    assert got == {(0, "Alpha"): 1 + 3 + 2, (1, "Beta"): 3, (1, "Gamma"): 1, (2, "Gamma"): 1}
    best = {r.doc_id: (r.domain, r.confidence) for r in domain.detect_domain(d, lex).collect()}
    assert best == {0: ("Alpha", 100.0), 1: ("Beta", 75.0), 2: ("Gamma", 100.0), 3: (v.GENERAL, 0.0), 4: (v.UNKNOWN, 0.0), 5: (v.UNKNOWN, 0.0)}


def test_ties_and_alternatives(spark, lex):
    d = docs(spark, "query", "query deep")
    assert [r.domain for r in domain.detect_domain(d, lex).orderBy("doc_id").collect()] == ["Beta", "Alpha"]
    alt = sorted(tuple(r) for r in domain.alternatives(domain.score_domains(d, lex)).collect())
    assert alt == [(0, 2, "Beta"), (1, 2, "Beta"), (1, 3, "Alpha")]  # names falling: the winner can come again


def test_lexicon_terms(spark, lex):
    d = docs(spark, "Neural network is first. The NETWORK and a network. Deep is here.", "zzz")
    got = {r.doc_id: r.terms for r in domain.lexicon_terms(d, lex).collect()}
    assert got == {0: ["deep", "network", "neural network"], 1: []}


def test_profile(spark, lex):
    none = F.array().cast("array<string>")
    d = docs(spark, "A neural network of deep networks and a query").select("*", F.array(F.lit("deep")).alias("terms"), none.alias("abbreviations"), none.alias("formulas"), none.alias("units"))
    r = domain.profile(d, lex).first()
    assert (r.domain, r.subdomain, r.language, r.important_concepts) == ("Science", "Alpha", "English", ["deep"]) and r.alternatives == ["Gamma", "Beta"]


BLOCKS = "doc_id int, page_no int, page_h double, block_pos int, x0 double, y0 double, x1 double, y1 double, text string, block_type int"


def pages(n):
    for i in range(n):
        yield (1, i, 800.0, 0, 0.0, 20.0, 9.0, 40.0, f"Header  {i}", 0)
        yield (1, i, 800.0, 1, 0.0, 100.0, 9.0, 200.0, f"Body {i}", 0)
        yield (1, i, 800.0, 2, 0.0, 760.0, 9.0, 780.0, f"Page {i}", 0)
        yield (1, i, 800.0, 3, 0.0, 300.0, 9.0, 400.0, "image", 1)


def test_furniture(spark):
    assert sorted(r.text for r in layout.filter_furniture(spark.createDataFrame(list(pages(6)), BLOCKS)).collect()) == [f"Body {i}" for i in range(6)]
    few = layout.filter_furniture(spark.createDataFrame(list(pages(2)), BLOCKS))
    assert sorted(r.text for r in few.collect()) == ["Body 0", "Body 1", "Header  0", "Header  1"]


def test_page_lines(spark):
    rows = []
    for i in range(5):
        for j, line in enumerate(["My Book", f"line {i} a", "same middle", "text", f"line {i} b", "", "closing", f"- {i} -"]):
            rows.append((1, i, j, line))
    out = layout.strip_page_lines(spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, text string")).orderBy("page_no").collect()
    assert out[2].text == "same middle\ntext\nline 2 b"


def test_merge_blocks(spark):
    rows = [(1, i, x) for i, x in enumerate(["First part", "goes  on\nhere.", "Second (x.)", " ", None, 'Quote."', "a:", "last"])]
    out = layout.merge_blocks(spark.createDataFrame(rows, "doc_id int, pos int, text string")).orderBy("para_pos").collect()
    assert [r.text for r in out] == ["First part goes on here.", "Second (x.)", 'Quote."', "a:", "last"]


FILES = "batch_id int, pos int, name string, paragraphs array<string>, source_type string, pages int, used_ocr boolean, warnings array<string>, error string"


def test_merge_files(spark):
    rows = [
        (1, 0, "a_b.txt", ["x", "y"], "txt", None, False, [], None), (1, 1, "copy.txt", ["x", "y"], "txt", None, False, [], None),
        (1, 2, "c.pdf", ["z"], "pdf", 3, True, ["w"], None), (1, 3, "bad.txt", [], None, None, False, [], "broken"),
        (2, 0, "one.txt", ["only"], "txt", None, False, [], None), (3, 0, "bad.txt", [], None, None, False, [], "broken"),
    ]
    rows += [(4, i, f"{i}.txt", [str(i)], "txt", None, False, [], None) for i in range(11)]
    out = {r.batch_id: r for r in layout.merge_files(spark.createDataFrame(rows, FILES)).collect()}
    assert out[1].paragraphs == ["Tài liệu 1: a b.", "x", "y", "Tài liệu 2: c.", "z"] and out[1].pages == 3 and out[1].used_ocr
    assert out[1].warnings == ["[c.pdf] w", "Bỏ qua 'copy.txt': nội dung trùng với 'a_b.txt'.", "Bỏ qua 'bad.txt': broken"] and len(out[1].sources) == 2
    assert out[2].paragraphs == ["only"] and out[2].source_type == "txt" and out[2].error is None
    assert "broken" in out[3].error and "11" in out[4].error


def pairs(spark, summary, source, **more):
    df = spark.createDataFrame([(1, summary, source)], "doc_id int, summary string, source string")
    for name, x in more.items():
        df = df.withColumn(name, F.array(*map(F.lit, x)).cast("array<string>"))
    return df


def test_preservation(spark):
    s, src = F.col("summary"), F.col("source")
    d = pairs(spark, "y=Wx+b with 91 % and 32 GB, 32 GB", "91 % and 16 GB", f=["y = Wx + b", "E = mc^2"], t=["with", "gb", " ", "absent"])
    r = d.select(measures.number_preservation(s, src).alias("n"), measures.unit_preservation(s, src).alias("u"), measures.formula_preservation(s, F.col("f")).alias("f"), measures.term_preservation(s, F.col("t")).alias("t"), measures.compression(s, src).alias("c")).first()
    assert r.n.unsupported == ["32"] and r.n.rate == pytest.approx(1 / 3) and r.u.rate == 0.5 and r.u.unsupported == ["32 GB"]
    assert (r.f.kept, r.f.total) == (1, 2) and (r.t.kept, r.t.total) == (2, 3)
    e = pairs(spark, "no figures", "", t=[]).select(measures.number_preservation(s, src).alias("n"), measures.term_preservation(s, F.col("t")).alias("t"), measures.compression(s, src).alias("c")).first()
    assert e.n is None and e.t is None and e.c is None


ABBR = "array<struct<abbr:string,long:string>>"


def test_validation(spark):
    src = "Neural networks learn from data in steps. The Artificial Intelligence (AI) field has 8 parts in all. Models are trained with 16 GB of data each. Results of models are checked by people."
    one = F.array(F.struct(F.lit("AI").alias("abbr"), F.lit("Artificial Intelligence").alias("long")))
    check = lambda s: measures.validate(pairs(spark, s, src).withColumn("abbreviations", one)).first()
    good = check("Neural networks learn from data in steps.")
    assert not good.needs_review and good.n_sentences == 1 and good.grounding_mean > 0.12
    bad = check("There were 97 % of apples in pears. Apple Icecream (AI) tastes very fine today.")
    assert bad.unsupported_numbers == ["97"] and bad.unsupported_units == ["97 %"] and bad.abbreviation_conflicts[0].summary == "Apple Icecream" and bad.needs_review
    off = check("Bananas grow under tropical sunshine happily.")
    assert len(off.ungrounded_sentences) == 1
    empty = check("")
    assert empty.n_sentences == 0 and not empty.needs_review and empty.grounding_mean is None


def test_methods_report(spark):
    rows = [(1, "A", "one two three four.", "one two three four. five six seven eight."), (2, "A", "", "x y z w."), (1, "B", "five six.", "five six seven eight.")]
    none = F.array().cast("array<string>")
    d = spark.createDataFrame(rows, "doc_id int, method string, summary string, source string").withColumn("terms", none).withColumn("formulas", none)
    refs = spark.createDataFrame([(1, "one two three four")], "doc_id int, reference string")
    scores = measures.score_methods(d, refs)
    rep = {r.method: r for r in measures.summarize_rows(scores).collect()}
    assert rep["A"].n_docs == 2 and rep["A"].rouge1_n == 1 and rep["A"].rouge1 == 1.0 and rep["A"].npr is None and rep["A"].compression == 0.25


PRED = "method string, grp string, label string, pred string, conf double, pos long"


def test_statistics(spark):
    rows = [("m", f"g{i % 4}", "xy"[i % 2], "xy"[(i % 2) ^ (i % 5 == 0)], (i % 11) / 10, i) for i in range(40)] + [("n", f"g{i % 4}", "xy"[i % 2], "x", 1.0, i) for i in range(40)]
    p = spark.createDataFrame(rows, PRED)
    from sklearn_free import metrics  # local helper below

    for method in "mn":
        mine = [(r[2], r[3]) for r in rows if r[0] == method]
        got = stats.accuracy(p).where(F.col("method") == method).first()
        acc, f1 = metrics(mine)
        assert got.accuracy == pytest.approx(acc) and got.macro_f1 == pytest.approx(f1)
    cov = {(r.method, r.threshold): r for r in stats.coverage(p, [0.5, 2.0]).collect()}
    assert cov["n", 0.5].coverage == 1.0 and cov["n", 2.0].accuracy is None and cov["n", 2.0].coverage == 0
    bins = stats.calibration(p).where("method = 'n'").collect()
    assert [(r.bin, r.n) for r in bins] == [(4, 40)] and stats.expected_calibration_error(stats.calibration(p)).where("method = 'n'").first().ece == 0.5
    v1, b = stats.votes(p), stats.bootstrap(p, ["x", "y"], 100).collect()
    assert all(0 <= r.accuracy_low <= r.accuracy_high <= 1 and 0 <= r.f1_low <= r.f1_high <= 1 for r in b)
    assert {(r.a, r.b) for r in stats.mcnemar(v1).collect()} == {("m", "n")}
    ties = spark.createDataFrame([("m", "g", "x", "b", 0.1, 5), ("m", "g", "x", "a", 0.1, 9)], PRED)
    assert stats.votes(ties).first().pred == "b"
    w = stats.wilson_intervals(v1).where("method = 'n'").first()
    assert (w.k, w.n) == (2, 4) and w.low < 0.5 < w.high


def test_classifier(spark, tmp_path):
    rows = [(f"{c}{i}", c, f"{c}word other {c}thing number {i} shared words") for c in ("red", "blue") for i in range(8)]
    d = spark.createDataFrame(rows, "grp string, label string, text string")
    for kind in ("logreg", "nb"):
        out = ml.cross_validate(d, 2, kind=kind, vocabulary=500)
        assert out.where("label = pred").count() == 16
    model = ml.fit(d, vocabulary=500)
    ml.save(spark, model, f"{tmp_path}/model")
    again = ml.load(spark, f"{tmp_path}/model")
    test = spark.createDataFrame([("redword redthing",), ("",)], "text string")
    got = [(r.pred, r.conf) for r in ml.predict(again, test).collect()]
    assert got[0][0] == "red" and 50 < got[0][1] <= 100 and got[1] == (v.UNKNOWN, 0.0)
    assert ml.predict(None, test).first().pred == v.UNKNOWN
    assert ml.learning_curve(d.where("grp in ('red0', 'red1', 'blue0', 'blue1')"), 1, 1)[0]["n_tests"] == 4


TERMS = ["Graph", "Vector", "Matrix", "Tensor", "Kernel", "Neural Net", "Loss"]
TEXT = " ".join(f"The {a} is related to the {b} in many ways." for a, b in zip(TERMS, TERMS[1:], strict=False))


def test_local_quiz(spark):
    d = docs(spark, TEXT, "").select("*", F.array(*map(F.lit, TERMS)).alias("terms"), F.array(*(F.struct(F.lit(a).alias("abbr"), F.lit(x).alias("long")) for a, x in (("AB", "A b"), ("CD", "C d"), ("EF", "E f"), ("GH", "G h")))).alias("abbreviations"))
    a, b = ([tuple(map(str, r)) for r in quiz.generate_local(d, 6, seed).orderBy("doc_id", "item_no").collect()] for seed in (1, 1))
    assert a == b and a != [tuple(map(str, r)) for r in quiz.generate_local(d, 6, 2).orderBy("doc_id", "item_no").collect()]
    for r in quiz.generate_local(d, 6, 1).collect():
        assert len({o.lower() for o in r.options}) == 4 and 0 <= r.answer < 4
        if r.type == "cloze":
            assert r.options[r.answer].lower() not in r.q.lower() and "_____" in r.q
    got = quiz.distractors(docs(spark, "").select("doc_id", F.array(*map(F.lit, TERMS)).alias("terms"))).where("term = 'Graph'").orderBy("rank").collect()
    assert [r.other for r in got] == ["Kernel", "Loss", "Matrix", "Tensor", "Vector", "Neural Net"]


def item(**more):
    return {"q": "What?", "options": ["Graph", "b", "c", "d"], "answer": 0, "explain": "", "evidence": "Graph is related to the"} | more


def test_checked_items():
    items = [item(), item(q="what?"), item(q="a", options=["x"]), item(q="b", evidence="never was there"), item(q="c", options=["Zzz", "b", "c", "d"]), item(q="d", answer=7), "junk", {"q": "e"}]
    kept, dropped = quiz.check_items(items, TEXT)
    assert len(kept) == 1 and kept[0]["options"][kept[0]["answer"]] == "Graph"
    assert dropped == [quiz.REPEATED, quiz.BAD_FORMAT, quiz.NO_EVIDENCE, quiz.NO_ANSWER, quiz.BAD_FORMAT, quiz.BAD_FORMAT, quiz.BAD_FORMAT]
    assert quiz.parse_items('so: [{"q": 1}] end') == [{"q": 1}] and quiz.parse_items("{}") is None and quiz.parse_items(None) is None


def test_quiz_with_a_model():
    from quire.functions import kernels as k

    sents = [s for s in k.sentences(TEXT) if len(k.tokens(s)) >= 7]
    got, rep = quiz.generate(lambda text, n: json.dumps([item()]), TEXT, TERMS, sents, [], 3)
    assert got[0]["type"] == "mcq" and rep["model"] == 1 and rep["offline"] == len(got) - 1 == 2
    got, rep = quiz.generate(lambda text, n: 1 / 0, TEXT, TERMS, sents, [], 3)
    assert "ZeroDivisionError" in rep["error"] and rep["offline"] == 3


def test_attempts(spark):
    answers = spark.createDataFrame([("l", 1, 0, 2, 2), ("l", 1, 1, 0, 3), ("l", 1, 2, 1, None)], "lesson_id string, attempt int, item_no int, answer int, given int")
    r = quiz.grade(answers).first()
    assert (r.score, r.total, r.wrong) == (1, 3, [1, 2])
    many = spark.createDataFrame([("l", i, i, i % 4, 4) for i in range(30)], "lesson_id string, attempt int, time int, score int, total int")
    assert quiz.latest_attempts(many).agg(F.min("attempt")).first()[0] == 10
    s = quiz.attempt_stats(many).first()
    assert (s.n, s.best, s.last, s.passed) == (30, 0.75, 0.25, True)


A, B = "a" * 32, "b" * 32


def test_library(spark, tmp_path):
    lib = store.Library(spark, f"{tmp_path}/lessons")
    one, two = lib.save(A, "One", "{}", summary="**s**"), lib.save(B, None, "{}", file_name="f.txt")
    assert [r.title for r in lib.list(A).collect()] == ["One"] and lib.list(B).first().title == "f.txt"
    assert lib.rename(A, one, " New ") and not lib.rename(B, one, "Stolen") and not lib.rename(A, one, "  ")
    assert lib.touch(A, one) and lib.set_audio(A, one, b"sound", "info")
    r = lib.list(A).first()
    assert (r.title, r.has_audio, r.audio_bytes, r.summary_preview) == ("New", True, 5, "s") and lib.audio(A, one) == b"sound" and lib.audio(B, one) is None
    assert lib.get(B, one).count() == 0 and not lib.delete(B, one) and lib.delete(A, one) and lib.list(A).count() == 0
    lost = lib.save(None, "Lost", "{}")
    assert lib.list(A).count() == 0 and lib.adopt_orphans(A) == 1 and lib.adopt_orphans(B) == 0
    assert lib.get(A, lost).first().title == "Lost" and lib.get(B, lost).count() == 0 and lib.list(B).first().id == two


def test_racing_renames_have_one_winner(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    lib = store.Library(spark, f"{tmp_path}/lessons")
    one = lib.save(A, "One", "{}")
    held, link = [], lib._link
    import threading

    both = threading.Barrier(2, timeout=120)

    def late(source, target):
        both.wait()  # both have read the same version and written theirs aside
        return link(source, target)

    lib._link = late
    with ThreadPoolExecutor(2) as pool:
        held = list(pool.map(lambda x: lib.rename(A, one, x), ["Left", "Right"]))
    lib._link = link
    assert sorted(held) == [False, True]
    r = lib.get(A, one).first()
    assert (r.title, r.version) == (["Left", "Right"][held.index(True)], 2)
    with pytest.raises(FileExistsError):
        lib.save(A, "Again", "{}", lesson=one)


def test_a_lost_race_of_another_kind_is_tried_again(spark, tmp_path):
    lib = store.Library(spark, f"{tmp_path}/lessons")
    one, link, first = lib.save(A, "One", "{}"), lib._link, []

    def late(source, target):
        if not first:
            first.append(1)
            assert store.Library(spark, f"{tmp_path}/lessons").touch(A, one)
        return link(source, target)

    lib._link = late
    assert lib.rename(A, one, "New")
    r = lib.get(A, one).first()
    assert (r.title, r.version) == ("New", 3) and r.last_opened_at is not None


def test_compaction_keeps_the_state(spark, tmp_path):
    lib = store.Library(spark, f"{tmp_path}/lessons")
    one, two, three = lib.save(A, "One", "{}"), lib.save(A, "Two", "{}", lesson="odd/id-2"), lib.save(A, "Three", "{}")
    other = lib.save(B, "Other", "{}")
    lost = lib.save(None, "Lost", "{}")
    assert lib.adopt_orphans(A) == 1 and lib.rename(A, lost, "Found")
    assert lib.rename(A, two, "Second") and lib.set_audio(A, two, b"x") and lib.delete(A, three)
    rows = lambda: sorted(map(tuple, lib.state(A).collect()), key=repr)
    before = rows()
    assert lib.compact(A) == 6 and rows() == before and lib.get(A, three).count() == 0
    assert lib.rename(A, one, "First") and lib.get(A, one).first().version == 2 and not lib.rename(A, three, "Back")
    again = rows()
    assert lib.compact(A, 3) == 2 and rows() == again and lib.audio(A, two) == b"x" and lib.get(B, other).count() == 1
    # A writer that read a version which a snapshot has gone past finds its name free; its version counts for nothing.
    row = spark.range(1).selectExpr("'odd/id-2' AS id", "2L AS version", "'rename' AS op", *(f"cast({'NULL' if c != 'title' else repr('Stale')} as {x}) AS {c}" for c, x in store.FIELDS.items()), "cast(NULL as string) AS heir")
    assert lib._publish(row, A, lib._file(two, 2)) and rows() == again


def test_two_adoptions_share_nothing(spark, tmp_path):
    lib = store.Library(spark, f"{tmp_path}/lessons")
    lost, link, first = lib.save(None, "Lost", "{}"), lib._link, []

    def late(source, target):
        if not first:
            first.append(1)
            assert store.Library(spark, f"{tmp_path}/lessons").adopt_orphans(B) == 1
        return link(source, target)

    lib._link = late
    assert lib.adopt_orphans(A) == 0 and lib.get(A, lost).count() == 0 and lib.get(B, lost).first().title == "Lost"


def test_a_lessons_quiz(spark, tmp_path):
    lib = store.Library(spark, f"{tmp_path}/lessons")
    one = lib.save(A, "One", '{"summary": "s"}')
    assert lib.quiz(A, one) is None and not lib.add_attempt(A, one, 1, 2, [0]) and not lib.save_quiz(B, one, [], {})
    assert lib.save_quiz(A, one, [{"q": "?"}], {"n": 1})
    assert all(lib.add_attempt(A, one, i, 4, [i], most=3) for i in range(4))
    got = lib.quiz(A, one)
    assert [x["score"] for x in got["history"]] == [1, 2, 3] and got["questions"] == [{"q": "?"}]
    assert lib.save_quiz(A, one, [], {}) and lib.quiz(A, one)["history"] == [] and '"summary": "s"' in lib.get(A, one).first().data


@pytest.mark.parametrize("bad", ["", None, "x", "A" * 32, "a" * 31, "a" * 33, "g" * 32, "a" * 31 + "\n", "../" + "a" * 29])
def test_owner_guard(spark, tmp_path, bad):
    assert not store.valid_owner(bad)
    with pytest.raises(PermissionError):
        store.Library(spark, str(tmp_path)).list(bad)
    assert store.pick_owner(bad, A) == A and store.valid_owner(store.pick_owner(bad))


class Scripted:
    def __init__(self, **answers):
        self.answers, self.asked = answers, []

    def complete(self, model, prompt):
        self.asked.append(model)
        got = self.answers[model].pop(0)
        if isinstance(got, Exception):
            raise got
        return got


def caller(**answers):
    waits = []
    c = models.Caller(Scripted(**answers), tuple(answers), sleep=waits.append)
    return c, waits


def test_retries():
    c, waits = caller(a=[RuntimeError("429 quota"), "*yes*"], b=["no"])
    assert c("p") == "yes" and waits == [3] and c.used == "a"
    c, waits = caller(a=[RuntimeError("404 not found")], b=["next"])
    assert c("p") == "next" and waits == [] and c.used == "b"
    c, waits = caller(a=[RuntimeError("503 overloaded")] * 4, b=["late"])
    assert c("p") == "late" and waits == [3, 8, 15]
    c, _ = caller(a=[ValueError("bad key")], b=["never"])
    with pytest.raises(ValueError):
        c("p")
    c, _ = caller(a=[RuntimeError("429 one")] * 4, b=[RuntimeError("429 last")] * 4)
    with pytest.raises(RuntimeError, match="last"):
        c("p")


class Says:
    def __init__(self, f):
        self.f, self.prompts = f, []

    def complete(self, model, prompt):
        self.prompts.append(prompt)
        return self.f(prompt)


def say(f):
    return models.Caller(Says(f), ("m",), delays=())


LONG = " ".join(f"This is sentence number {i} of the text." for i in range(2000))


def fail(message):
    def f(prompt):
        raise RuntimeError(message)

    return f


def test_map_reduce():
    assert models.map_reduce(say(fail("x")), "short")[0] == "short"
    text, plan = models.map_reduce(say(lambda p: "part"), LONG)
    assert text == "part" and plan["chunks"] > 1 and plan["fallback_chunks"] == 0
    c = say(fail("429"))
    text, plan = models.map_reduce(c, LONG)
    assert text.startswith(v.ERROR_PREFIX) and len(c.client.prompts) == 1 and plan["fallback_chunks"] == plan["chunks"]
    half = say(lambda p: "ok" if "part 1 of" in p else 1 / 0)
    text, plan = models.map_reduce(half, LONG)
    assert text.startswith("ok\n\n") and plan["fallback_chunks"] == plan["chunks"] - 1
    guided = say(lambda p: p).guided(" GUIDE")
    assert guided("x").endswith("GUIDE")


def test_reading():
    body = lambda p: p.split("\n\n", 1)[1]
    text = "Author line\n\n" + "Word after word. " * 120
    out, rep = models.reading_text(say(body), text)
    assert rep["ai"] == 1 and out == text.strip()
    assert models.reading_text(say(lambda p: "tiny"), text)[1]["kept_raw"] == 1
    out, rep = models.reading_text(say(fail("boom")), text)
    assert rep["errors"] == ["boom"] and out == text.strip()
    assert models.reading_text(say(lambda p: v.SKIP_MARK), "Author")[0] == ""
    assert models.reading_text(say(lambda p: v.SKIP_MARK), "Word. " * 900)[1]["kept_raw"] == 1
    assert models.reading_text(say(body), "")[0] == ""


def test_models_on_frames(spark):
    d = docs(spark, LONG, "")
    out = {r.doc_id: r for r in models.on_documents(d, lambda: say(lambda p: "x"), models.map_reduce).collect()}
    assert out["0"].result == "x" and json.loads(out["0"].report)["chunks"] > 1 and out["1"].result == ""

    def voices():
        return [lambda p: 1 / 0, lambda p: p.encode()]

    audio = {r.doc_id: r for r in models.speak(docs(spark, "Some words. More words.", ""), voices).collect()}
    assert bytes(audio["0"].audio) == b"Some words. More words." and audio["0"].engine == 1 and bytes(audio["1"].audio) == b""
    assert models.choose_model(["models/a-flash", "b-pro", "c-flash-tts"]) == ["a-flash"]
    assert models.list_voices(lambda: 1 / 0, ("d",)) == ["d"] and models.list_voices(lambda: ["en-Multilingual", "vi-X"], ("d",), True) == ["vi-X", "en-Multilingual"]


def test_relational_ranking(spark):
    from quire.functions import kernels as k

    text = "cats like warm milk today. dogs like cold water today. birds like warm seeds here."
    e = {(r.i, r.j): r.w for r in rank.similarity_edges(docs(spark, text)).collect()}
    assert set(e) == {(0, 1), (0, 2), (1, 2)} and all(0 < w < 1 for w in e.values())
    top = rank.textrank(docs(spark, text), 2).collect()
    assert [r.pos for r in top] == k.textrank(text, 2) and top[0].sentence == k.sentences(text)[top[0].pos]


def test_no_sentence_is_cut_off(spark):
    d = docs(spark, " ".join(f"Alpha{i % 1500} beta{i} runs far." for i in range(2100)))
    assert rank.sentence_table(d).count() == 2100
    w = {(r.pos, r.token): r.w for r in rank.sentence_tfidf(d).collect()}
    assert max(p for p, _ in w) == 2099 and w[2099, "beta2099"] == pytest.approx(math.log(2101 / 2) + 1)
    assert rank.similarity_edges(d.limit(1)).agg({"j": "max"}).first()[0] == 2099


def test_fit_takes_every_term(spark):
    n = 140_000  # with the pairs, more than 2 ** 18 terms
    rows = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(n))), ("b", "other words")], "label string, text string")
    assert ml.fit(rows, "nb").terms.count() == n + n - 1 + 3


class _Counting:
    """A client that notes how many calls run at a time, and fails where told."""

    def __init__(self, fails=lambda prompt: None):
        import threading

        self.lock, self.now, self.most, self.asked, self.fails = threading.Lock(), 0, 0, [], fails

    def __call__(self, prompt):
        import time

        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.asked.append(prompt)
        try:
            time.sleep(0.002 * (len(prompt) % 5))
            error = self.fails(prompt)
            if error:
                raise error
            return f"<{prompt}>"
        finally:
            with self.lock:
                self.now -= 1


def test_calls_in_flight_are_bounded_and_in_order():
    parts = [f"p{i}" * (i % 7 + 1) for i in range(40)]
    for at_once in (1, 3):
        client = _Counting()
        assert models.in_order(client, parts, at_once) == [f"<{p}>" for p in parts]
        assert client.most <= at_once and sorted(client.asked) == sorted(parts)
    wide = _Counting()
    models.in_order(wide, parts, 8)
    assert 1 < wide.most <= 8


def test_a_limit_stops_the_parts_that_wait():
    client = _Counting(lambda p: RuntimeError("429 quota") if p == "p5" else None)
    got = models.in_order(client, [f"p{i}" for i in range(60)], 2, trips=models.is_rate_limit)
    assert isinstance(got[5], RuntimeError) and got[:5] == [f"<p{i}>" for i in range(5)]
    assert len(client.asked) <= 9 and got[20:] == [None] * 40
    other = _Counting(lambda p: ValueError("odd") if p == "p5" else None)
    got = models.in_order(other, [f"p{i}" for i in range(20)], 2, trips=models.is_rate_limit)
    assert len(other.asked) == 20 and isinstance(got[5], ValueError) and got[19] == "<p19>"


def test_map_reduce_keeps_parts_in_order_and_trips():
    text = "\n\n".join(f"Part number {i} says something of its own about topic {i}. " * 60 for i in range(12))
    joined = []

    def call(prompt):
        if prompt.startswith("This is part"):
            return "S" + prompt.split("part ")[1].split(" ")[0]
        joined.append(prompt)
        return "whole"

    got, plan = models.map_reduce(call, text, calls=8, at_once=4)
    assert got == "whole" and plan["chunks"] > 2 and plan["fallback_chunks"] == 0
    assert "\n\n".join(f"S{i}" for i in range(1, plan["chunks"] + 1)) in joined[0]

    def limited(prompt):
        if prompt.startswith("This is part 1 ") or not prompt.startswith("This is part"):
            return "fine"
        raise RuntimeError("429")

    got, plan = models.map_reduce(limited, text, calls=8, at_once=1)
    assert got == "fine" and plan["fallback_chunks"] == plan["chunks"] - 1
    got, plan = models.map_reduce(lambda p: (_ for _ in ()).throw(RuntimeError("429 first")), text, calls=8)
    assert got.endswith("429 first") and plan["fallback_chunks"] == plan["chunks"]


def test_history_counts_since_the_newest_save(spark):
    log = [("a", t, t, "save" if t in (3, 10) else "attempt", t) for t in range(40)] + [("b", t, t, "attempt", t) for t in range(3)] + [("c", 5, 1, "attempt", 1), ("c", 5, 2, "save", 2), ("c", 5, 3, "attempt", 3)]
    got = quiz.since_save(spark.createDataFrame(log, "lesson_id string, time int, seq int, op string, score int")).collect()
    assert sorted((r.lesson_id, r.score) for r in got) == [("a", t) for t in range(20, 40)] + [("c", 3)]
    few = quiz.since_save(spark.createDataFrame(log[:14], "lesson_id string, time int, seq int, op string, score int"), 2)
    assert sorted(r.score for r in few.collect()) == [12, 13]
