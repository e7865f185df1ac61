"""Text functions as Column expressions: no Python worker, no shuffle, usable on batches and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import values as v

W = v.W


def _s(x: str) -> Column:
    return F.lit(x)


def filled(text: Column) -> Column:
    return F.coalesce(text, _s(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, even where the body's lambdas use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end, whatever its kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quoted(text: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.concat(_s("\\Q"), F.replace(text, _s("\\E"), _s("\\E\\\\E\\Q")), _s("\\E"))


def bounded(word: Column, flags: str = "") -> Column:
    """A pattern of the word with nothing of a word next to it."""
    return F.concat(_s(flags + v.LEFT), quoted(word), _s(v.RIGHT))


# --- normalisation -------------------------------------------------------------------------------------------------


def squeeze(text: Column) -> Column:
    """Control signs out, runs of blanks to one, at most one empty line in a row, stripped. Unicode form is kept: see ``arrow.normalize``."""
    t = F.regexp_replace(filled(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_ocr_noise(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+[|_^]\s+", " ")


def clean_for_speech(text: Column) -> Column:
    """Markdown signs and list marks out."""
    t = F.regexp_replace(text, r"[*_#`>]+", "")
    t = F.regexp_replace(t, r"(?Um)^\s*[-•]\s+", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def preview(text: Column, limit: int = 160) -> Column:
    t = strip(F.regexp_replace(F.regexp_replace(filled(text), r"[*_#`>]+", " "), r"(?U)\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, _s(limit - 1))), _s("…"))).otherwise(t)


def stem(name: Column) -> Column:
    """A file's name without folders and extension, in words."""
    base = F.regexp_replace(F.regexp_extract(filled(name), r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")
    words = strip(F.regexp_replace(base, r"(?U)[_\-\s]+", " "))
    return F.when(words == "", "không tên").otherwise(words)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(filled(path), r"[^./](\.[^./]*)$", 1))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")


def reading_minutes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.size(words(text)) / 200).cast("int"))


def sample_parts(text: Column, limit: int = 12000, parts: int = 4) -> Column:
    """The text, or of a longer one ``parts`` slices that lie evenly, with empty lines between."""
    size = limit // parts
    step = (F.length(text) - size) / max(1, parts - 1)
    slices = [F.substr(text, F.floor(step * i).cast("int") + 1, _s(size)) for i in range(parts)]
    return F.when(F.length(text) <= limit, text).otherwise(F.concat_ws("\n\n", *slices))


# --- tokens and sentences ------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(filled(text)), _s(f"{W}+"), _s(0))


def words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(filled(text), r"(?U)\s+"), lambda x: x != "")


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda x: (F.length(x) > 1) & ~x.isin(*v.STOPWORDS))


def _pieces(text: Column, pattern: str) -> Column:
    return F.split(filled(text), pattern)


def sentences(text: Column, least: int = 4) -> Column:
    """Sentences of at least ``least`` tokens, in order."""
    cut = F.transform(_pieces(text, r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(cut, lambda s: F.regexp_count(s, _s(f"{W}+")) >= least)


def quiz_sentences(text: Column, least: int = 7, most: int = 45) -> Column:
    """Sentences, cut at line ends too, of ``least`` to ``most`` tokens, without repeats in another case."""
    cut = F.transform(_pieces(text, r"(?U)(?<=[.!?])\s+|\n+"), lambda s: strip(F.regexp_replace(s, r"(?U)\s+", " ")))
    return first_by(F.filter(cut, lambda s: F.regexp_count(s, _s(f"{W}+")).between(least, most)), F.lower)


def first_by(array: Column, key) -> Column:
    """Elements whose key no earlier element has; a null key is no other's.

    Elements are sorted by key and place, and those behind an equal key go: comparing each with all before it would be
    quadratic, and a text may have thousands.
    """
    pairs = F.sort_array(F.transform(array, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    again = lambda a, p, i: F.coalesce(F.get(a, i - 1)["k"] == p["k"], F.lit(False))
    first = let(pairs, lambda a: F.filter(a, lambda p, i: ~again(a, p, i)))
    return F.transform(F.sort_array(F.transform(first, lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x")))), lambda p: p["x"])


def lead(text: Column, n: int = 3) -> Column:
    """The first sentences, joined by spaces."""
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def average_sentence_length(text: Column) -> Column:
    """Tokens a sentence, over sentences with tokens; null if there are none."""
    sizes = F.filter(F.transform(_pieces(strip(filled(text)), r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_count(s, _s(f"{W}+"))), lambda n: n > 0)
    return F.try_divide(F.aggregate(sizes, F.lit(0), lambda a, n: a + n).cast("double"), F.size(sizes))


# --- language and lines --------------------------------------------------------------------------------------------


def letters(text: Column) -> Column:
    """How many letters there are."""
    return F.length(F.regexp_replace(filled(text), r"[^\p{L}]+", ""))


def vietnamese_letters(text: Column) -> Column:
    low = F.lower(filled(text))
    return F.length(low) - F.length(F.translate(low, v.VI_LETTERS, ""))


def vietnamese_share(text: Column) -> Column:
    return F.try_divide(vietnamese_letters(text).cast("double"), letters(text))


def language(text: Column) -> Column:
    share = lambda c: F.try_divide(c["vi"].cast("double"), c["n"])
    kind = lambda c: F.when(c["n"] < 20, v.UNKNOWN).when(share(c) > 0.06, "Vietnamese").when(share(c) < 0.01, "English").otherwise("Mixed")
    return let(F.struct(letters(text).alias("n"), vietnamese_letters(text).alias("vi")), kind)


def is_page_number(line: Column, strict: bool = False) -> Column:
    s = strip(filled(line))
    hit = s.rlike(v.PAGE_MARKED) | s.rlike(v.PAGE_FRACTION)
    hit = hit if strict else hit | s.rlike(v.PAGE_BARE)
    return (s != "") & (F.length(s) <= 24) & hit


def signature(text: Column) -> Column:
    """What headers and footers of different pages have in common."""
    return F.regexp_replace(strip(F.regexp_replace(F.lower(filled(text)), r"(?U)\s+", " ")), r"\p{Nd}+", "#")


def drop_page_numbers(paragraphs: Column) -> Column:
    """Paragraphs without page numbers: whole ones go, in longer ones only marked lines."""
    lines = lambda p: F.split(F.regexp_replace(p, r"\n$", ""), r"\r\n|\n|\r")
    rest = lambda p: strip(F.array_join(F.filter(lines(p), lambda x: ~is_page_number(x, True)), "\n"))
    one = lambda p: F.size(lines(p)) <= 1
    kept = F.filter(paragraphs, lambda p: F.when(one(p), ~is_page_number(p)).otherwise(rest(p) != ""))
    return F.transform(kept, lambda p: F.when(one(p), p).otherwise(rest(p)))


def looks_like_code(line: Column) -> Column:
    s = strip(filled(line))
    hit = s.rlike("(?U)" + v.CODE_WORDS)
    for mark in v.CODE_MARKS:
        hit = hit | s.rlike("(?U)" + mark)
    return (s != "") & hit


def formula_shape(line: Column) -> Column:
    s = strip(filled(line))
    sign = s.rlike(r"\\(?:" + "|".join(v.LATEX) + ")") | s.contains("=") | s.rlike(f"[{v.MATH}{v.GREEK}]") | s.rlike(r"(?U)[A-Za-z)\]]\^[\w{(\-]")
    all_words = words(s)
    prose = F.size(F.filter(all_words, lambda x: x.rlike(r"^\p{L}{3,}[.,;:]?$")))
    return F.length(s).between(3, 160) & sign & (prose <= 2) & (prose <= 0.4 * F.size(all_words))


def looks_like_formula(line: Column) -> Column:
    return formula_shape(line) & ~looks_like_code(line)


_UNIT = rf"(?<![\p{{L}}\p{{N}}_.])(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?)(?U:\s?)({'|'.join(v.UNITS)})(?![A-Za-z])"


def units(text: Column) -> Column:
    """Distinct numbers with units, "n u", in order."""
    both = F.zip_with(F.regexp_extract_all(filled(text), _s(_UNIT), _s(1)), F.regexp_extract_all(filled(text), _s(_UNIT), _s(2)), lambda n, u: F.concat(n, _s(" "), u))
    return F.array_distinct(both)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(filled(text), _s(r"\p{Nd}+(?:[.,]\p{Nd}+)?"), _s(0))


def squash(text: Column) -> Column:
    return F.regexp_replace(filled(text), r"(?U)\s+", "")


# --- terms ---------------------------------------------------------------------------------------------------------

_CASED_WORD = r"^\p{Lu}[^\p{Lu}\p{Lt}]*\p{Ll}[^\p{Lu}\p{Lt}]*$"


def capitalized_phrases(text: Column) -> Column:
    """Runs of capitalised words; a single word that begins a sentence is none. Digits, commas and brackets don't break a run."""
    stop = F.array(*map(_s, v.PHRASE_STOP))
    found = F.regexp_extract_all(filled(text), _s(r"\p{L}+|[.!?:;\n]"), _s(0))
    mark = lambda x: F.when(x.rlike(r"^[.!?:;\n]$"), "\u0002").when(x.rlike(_CASED_WORD) & ~F.array_contains(stop, F.lower(x)), x).otherwise("\u0001")
    line = F.concat(_s("\u0002 "), F.array_join(F.transform(found, mark), " "))
    runs = F.regexp_extract_all(line, _s("(?:\u0002 )?\\p{L}+(?: \\p{L}+)*"), _s(0))
    good = F.filter(runs, lambda r: ~(r.startswith("\u0002") & ~F.substring(r, 3, 1 << 30).contains(" ")))
    return F.transform(good, lambda r: F.regexp_replace(r, "^\u0002 ", ""))


def terminology(text: Column) -> Column:
    """Acronyms, camel-case words, capitalised phrases and code tokens: sorted, distinct."""
    t = filled(text)
    ends = lambda body: f"(?U)\\b(?-U:{body})\\b"
    acronyms = F.regexp_extract_all(t, _s(ends("[A-Z]{2,}")), _s(0))
    camel = F.regexp_extract_all(t, _s(ends("[A-Z]?[a-z]+[A-Z][a-z]*[A-Za-z]*")), _s(0))
    code = F.regexp_extract_all(t, _s(ends("[a-zA-Z0-9_]+[:/][a-zA-Z0-9_:/]+")), _s(0))
    phrases = F.filter(capitalized_phrases(text), lambda p: F.length(p) > 3)
    return F.array_sort(F.array_distinct(F.concat(acronyms, camel, phrases, code)))


def clean_terms(terms: Column, text: Column, least: int = 2, most_words: int = 4, stop: tuple[str, ...] = v.TERM_STOP) -> Column:
    """One display form of each term, case aside: no long phrases and stop words; single words need evidence in the text."""
    from quire.functions import arrow

    return arrow.clean_terms(terms, text, least, most_words, stop)


def merge_terms(first: Column, second: Column) -> Column:
    """Both lists, case aside; the first one's form stays. Sorted by lower case."""
    return F.transform(F.array_sort(F.transform(first_by(F.concat(first, second), F.lower), lambda x: F.struct(F.lower(x).alias("k"), x.alias("x")))), lambda p: p["x"])


def acronym_uses(text: Column) -> Column:
    return F.regexp_extract_all(filled(text), _s(r"(?<![\p{L}\p{N}_\-])([A-Z][A-Z0-9]{1,5})(?![\p{L}\p{N}_\-])"), _s(1))


def undefined_abbreviations(text: Column, defined: Column, least: int = 2) -> Column:
    """Acronyms used at least ``least`` times and not in ``defined``, sorted."""
    often = let(acronym_uses(text), lambda uses: F.filter(F.array_distinct(uses), lambda a: F.size(F.filter(uses, lambda x: x == a)) >= least))
    return F.array_sort(F.array_except(often, F.coalesce(defined, F.array().cast("array<string>"))))


def top_concepts(text: Column, terms: Column, k: int = 10) -> Column:
    """The terms that occur most often, ties by lower case."""
    from quire.functions import arrow

    return arrow.top_concepts(text, terms, k)


def candidate_terms(terms: Column) -> Column:
    """Terms that can be quiz answers."""
    t = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    stop = F.array(*map(_s, v.QUIZ_STOP))
    good = lambda x: F.length(x).between(3, 40) & ~F.array_contains(stop, F.lower(x)) & ~x.rlike(r"^\p{Nd}+$") & (F.size(F.split(x, " ")) <= 4) & ~x.rlike(r"[:/\\.]")
    return first_by(F.filter(t, good), F.lower)


def glossary_guide(terms: Column, abbreviations: Column, formulas: Column) -> Column:
    """What a prompt says about a document's terms, abbreviations (array of struct abbr, long) and formulas; empty if there are none."""
    some = lambda a, n, sep: F.array_join(F.slice(a, 1, n), sep)
    pairs = F.transform(abbreviations, lambda p: F.concat(p["abbr"], _s(" = "), p["long"]))
    lines = F.filter(
        F.array(
            F.when(F.size(terms) > 0, F.concat(_s("Thuật ngữ cần giữ nguyên, không dịch hay thay bằng từ khác: "), some(terms, 25, ", "), _s("."))),
            F.when(F.size(pairs) > 0, F.concat(_s("Từ viết tắt theo định nghĩa của tài liệu (không tự mở rộng cách khác): "), some(pairs, 15, "; "), _s("."))),
            F.when(F.size(formulas) > 0, F.concat(_s("Nếu nhắc tới các công thức sau, chép đúng nguyên văn: "), some(formulas, 8, " | "), _s("."))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(lines) > 0, F.concat(_s("\n\nLưu ý bắt buộc về nội dung chuyên ngành:\n"), F.array_join(lines, "\n"))).otherwise("")
