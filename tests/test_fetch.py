"""The collection on a client made here, which notes every call in a file."""

from quire.sources import fetch


class Client:
    def __init__(self, log, broken=False):
        self.log, self.broken = log, broken

    def pages(self):
        return 3

    def titles(self, page):
        return [("math", f"Đại số {page}"), ("math", "Missing one"), ("nlp", f"Short {page}"), ("nlp", "Broken")]

    def fetch(self, title):
        with open(self.log, "a") as f:
            f.write(title + "\n")
        if title == "Broken" and self.broken:
            raise RuntimeError("503")
        if title == "Missing one":
            return None
        words = 10 if title.startswith("Short") else 320
        return title.replace("số", "Số"), "word " * words + "\n== Tham khảo ==\ncut " * 1


def test_second_run_fetches_nothing(spark, tmp_path):
    log, root = tmp_path / "calls.txt", f"{tmp_path}/articles"
    log.touch()
    counts = lambda df: {(r.label, r.status): r.n for r in df.collect()}
    asked = lambda: sorted(log.read_text().splitlines())
    path = str(log)
    first = counts(fetch.fetch_new(spark, root, lambda: Client(path, broken=True)))
    assert first == {("math", "ok"): 3, ("math", "missing"): 1, ("nlp", "short"): 3, ("nlp", "failed"): 1}
    every = asked()
    assert len(every) == len(set(every)) == 8
    # What failed is asked for again, nothing else; then nothing is.
    assert counts(fetch.fetch_new(spark, root, lambda: Client(path))) == {("nlp", "ok"): 1}
    assert sorted(asked()) == sorted([*every, "Broken"])
    assert counts(fetch.fetch_new(spark, root, lambda: Client(path))) == {} and len(asked()) == 9
    # Missing and short ones on demand.
    assert counts(fetch.fetch_new(spark, root, lambda: Client(path), least_words=5, again=True)) == {("math", "missing"): 1, ("nlp", "ok"): 3}
    rows = {r.file: r for r in fetch.collection(spark, root).collect()}
    assert len(rows) == 8 and rows["nlp/wiki_short_1.txt"].status == "ok" and rows["math/wiki_missing_one.txt"].text is None
    one = rows["math/wiki_dai_so_0.txt"]
    assert one.words == 320 and one.text.startswith("Đại Số 0 — Wikipedia") and "cut" not in one.text
    credit = {r.file: r for r in fetch.attribution(fetch.collection(spark, root)).collect()}
    assert len(credit) == 7 and credit["math/wiki_dai_so_0.txt"].url.endswith("/%C4%90%E1%BA%A1i_S%E1%BB%91_0")
