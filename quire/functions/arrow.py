"""Row kernels as Arrow functions on columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quire.functions import kernels as k
from quire.functions import occurrences as o


#: Rows that a kernel has as Python values at a time.
ROWS = 128


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that a worker's memory doesn't grow with what Spark sends at a time."""
    return (b.slice(at, rows) for b in batches for at in range(0, max(1, b.num_rows), rows))


def rowwise(kernel: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """A kernel of one row's values as a function of columns; values pass in Arrow batches.

    The function is declared non-deterministic, so that the optimizer neither copies nor moves its work. A batch's values are
    Python's a few rows at a time.
    """
    typed = {1: _one, 2: _two, 3: _three}  # the number of arguments tells Spark the function's type

    def on(*columns: Column) -> Column:
        kind = to_arrow_type(_parse_datatype_string(returns))

        def batch(*values: pa.Array) -> pa.Array:
            parts = (zip(*(x.slice(at, ROWS).to_pylist() for x in values), strict=True) for at in range(0, max(1, len(values[0])), ROWS))
            return pa.concat_arrays([pa.array([kernel(*row) for row in rows], kind) for rows in parts])

        return F.arrow_udf(typed[len(columns)](batch), returns).asNondeterministic()(*columns)

    return on


def _one(f):
    def g(a: pa.Array) -> pa.Array:
        return f(a)

    return g


def _two(f):
    def g(a: pa.Array, b: pa.Array) -> pa.Array:
        return f(a, b)

    return g


def _three(f):
    def g(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return f(a, b, c)

    return g


_NFC = rowwise(k.nfc, "string")
_COMBINES = r"\p{M}|[ᄀ-ᇿ]|[ΩKÅ]"


def normalize(text: Column) -> Column:
    """Unicode form C, white space and control signs in order. Python is asked only for texts with combining marks."""
    from quire.functions import text as t

    return t.squeeze(F.when(text.rlike(_COMBINES), _NFC(text)).otherwise(text))


normalize_all = rowwise(k.normalized, "array<string>")  # ``normalize`` of each text of an array
slug = rowwise(k.slug, "string")
html_text = rowwise(k.html_text, "string")
article_text = rowwise(k.article_text, "string")
abbreviations = rowwise(lambda t: [{"abbr": a, "long": b} for a, b in k.abbreviations(t)], "array<struct<abbr:string,long:string>>")
formulas = rowwise(k.formulas, "array<string>")
_PRF = "struct<precision:double,recall:double,f1:double>"
_as_prf = lambda x: dict(zip(("precision", "recall", "f1"), x, strict=True))
rouge_l = rowwise(lambda a, b: _as_prf(k.rouge_l(a, b)), _PRF)


def rouge_n(got: Column, want: Column, n: int = 1) -> Column:
    return rowwise(lambda a, b: _as_prf(k.rouge_n(a, b, n)), _PRF)(got, want)


def chunks(text: Column, most: int = 6000, overlap: int = 300) -> Column:
    return rowwise(lambda t: k.chunks(t, most, overlap), "array<string>")(text)


def paragraph_chunks(paragraphs: Column, most: int = 6000) -> Column:
    return rowwise(lambda p: k.paragraph_chunks(p, most), "array<string>")(paragraphs)


def plan_chunks(text: Column, calls: int) -> Column:
    plan = lambda t: dict(zip(("chunks", "truncated", "size"), (*k.plan_chunks(t, calls), k.chunk_size(len(t or ""), calls)), strict=True))
    return rowwise(plan, "struct<chunks:array<string>,truncated:boolean,size:bigint>")(text)


def word_chunks(text: Column, size: int = 150, least: int = 40) -> Column:
    return rowwise(lambda t: k.word_chunks(t, size, least), "array<string>")(text)


def speech_chunks(text: Column, most: int = 700) -> Column:
    return rowwise(lambda t: k.speech_chunks(t, most), "array<string>")(text)


def speech(text: Column, pronunciation: dict[str, str] | None = None, voice: str = "") -> Column:
    return rowwise(lambda t: k.speech(t, pronunciation, "Multilingual" in voice), "string")(text)


def textrank(text: Column, n: int = 5, terms: Column | None = None, boost: float = 0.15) -> Column:
    """Places of the best sentences in order; null if there is no sentence."""
    return rowwise(lambda t, x: k.textrank(t, n, x, boost), "array<int>")(text, F.array().cast("array<string>") if terms is None else terms)


def summary(text: Column, n: int = 5, terms: Column | None = None, boost: float = 0.15) -> Column:
    return rowwise(lambda t, x: k.summary(t, n, x, boost), "string")(text, F.array().cast("array<string>") if terms is None else terms)


def summaries(text: Column, n: int, terms: Column) -> Column:
    """struct(plain, terms): the summary without and with ``terms``, of one ranking."""
    return rowwise(lambda t, x: dict(zip(("plain", "terms"), k.summaries(t, n, (None, x)), strict=True)), "struct<plain:string,terms:string>")(text, terms)


text_grounding = rowwise(lambda claims, text: k.text_grounding(claims or [], text), "array<double>")
grounding = rowwise(lambda claims, source: k.grounding(claims or [], source or []), "array<double>")
_pairs = lambda a: [(p["abbr"], p["long"]) for p in a or []]
conflicts = rowwise(lambda a, b: [dict(zip(("abbr", "source", "summary"), x, strict=True)) for x in k.conflicts(_pairs(a), _pairs(b))], "array<struct<abbr:string,source:string,summary:string>>")
mcnemar = rowwise(k.mcnemar, "double")


def keyword_counts(text: Column, keywords: o.Keywords) -> Column:
    """Uses of each keyword that occurs: its place among the keywords and a number."""
    kernel = lambda t: [{"i": i, "n": n} for i, n in o.Occurrences(t).counts(keywords).items()]
    return rowwise(kernel, "array<struct<i:int,n:bigint>>")(text)


def domain_scores(text: Column, keywords: o.Keywords, domains: list[tuple[int, str, list[int]]]) -> Column:
    """The domains (place, name, keywords) with a score, by place."""

    def kernel(t: str | None) -> list[dict]:
        n = o.Occurrences(t).counts(keywords)
        scores = ((d, name, sum(n.get(i, 0) for i in of)) for d, name, of in domains)
        return [{"domain_ord": d, "domain": name, "score": s} for d, name, s in scores if s]

    return rowwise(kernel, "array<struct<domain_ord:int,domain:string,score:bigint>>")(text)


def lexicon_terms(text: Column, keywords: o.Keywords, domains: list[list[int]], share: float) -> Column:
    return rowwise(lambda t: o.lexicon_terms(t, keywords, domains, share), "array<string>")(text)


def counted(terms: Column) -> Column:
    """The distinct terms, each with its number."""
    return rowwise(lambda a: [{"term": x, "tf": n} for x, n in Counter(a or ()).items()], "array<struct<term:string,tf:bigint>>")(terms)


def clean_terms(terms: Column, text: Column, least: int, most_words: int, stop: tuple[str, ...]) -> Column:
    words = frozenset(x.lower() for x in stop)
    return rowwise(lambda a, t: o.clean_terms(a, t, least, most_words, words), "array<string>")(terms, text)


def all_terms(terms: Column, text: Column, keywords: o.Keywords, domains: list[list[int]], share: float, least: int, most_words: int, stop: tuple[str, ...]) -> Column:
    """``clean_terms`` and ``lexicon_terms`` in one list, of one index of the text's words."""
    words = frozenset(x.lower() for x in stop)

    def kernel(a: list[str | None] | None, t: str | None) -> list[str]:
        seen = o.Occurrences(t)
        return o.merge_terms(o.clean_terms(a, t, least, most_words, words, seen), o.lexicon_terms(t, keywords, domains, share, seen))

    return rowwise(kernel, "array<string>")(terms, text)


def top_concepts(text: Column, terms: Column, n: int) -> Column:
    return rowwise(lambda t, a: o.top_concepts(t, a, n), "array<string>")(text, terms)
