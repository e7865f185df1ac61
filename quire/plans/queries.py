"""The registered queries over the driver's tables, and the SQL that gives the same rows.

Lexicon operators take their lexicon as a parameter; here it is made of the tables' own words: the 60 most frequent of six
letters or more, dealt to six domains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import arrow
from quire.functions import text as t
from quire.functions import values as v
from quire.operators import domain, layout, measures, ml, models, quiz, rank, stats, store
from quire.plans import pipeline
from quire.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
CUT = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
N_TOK = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'))"
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SENTS = "list_filter(list_transform(" + CUT + ", lambda s: " + TRIM.format("s") + "), lambda s: " + N_TOK.format("s").replace("{", "{{").replace("}", "}}") + " >= 4)"
STOP = "[" + ", ".join(f"'{w}'" for w in v.STOPWORDS) + "]"
CONTENT = "list_filter(" + TOK + ", lambda w: length(w) > 1 AND NOT list_contains(" + STOP + ", w))"
TOP_WORDS = f"lex AS (SELECT w AS keyword, rn, 'D' || (rn % 6) AS domain, rn % 6 AS ord FROM (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS rn FROM (SELECT unnest({TOK.format('text')}) AS w FROM documents) WHERE length(w) >= 6 GROUP BY w) WHERE rn <= 60)"


def top_words(spark: SparkSession, d: str, n: int = 60) -> list[str]:
    words = documents(spark, d).select(F.explode(t.tokens(F.col("text"))).alias("w")).where(F.length("w") >= 6)
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(n).collect()]


def made_lexicon(spark: SparkSession, d: str) -> DataFrame:
    domains: dict[str, list[str]] = {f"D{i}": [] for i in range(6)}
    for rn, w in enumerate(top_words(spark, d), 1):
        domains[f"D{rn % 6}"].append(w)
    return domain.lexicon(spark, domains)


# --- texts ---------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, n_letters, round(vi / nullif(n_letters, 0), 6) AS share,
  CASE WHEN n_letters < 20 THEN 'Unknown' WHEN vi / n_letters > 0.06 THEN 'Vietnamese' WHEN vi / n_letters < 0.01 THEN 'English' ELSE 'Mixed' END AS language
  FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\\p{{L}}')) AS INTEGER) AS n_letters, CAST(len(regexp_extract_all(lower(text), '[{v.VI_LETTERS}]')) AS DOUBLE) AS vi FROM documents)""")
def language_ratio(spark, d):
    x = F.col("text")
    return documents(spark, d).select("doc_id", t.letters(x).alias("n_letters"), F.round(t.vietnamese_share(x), 6).alias("share"), t.language(x).alias("language"))


@query(f"SELECT doc_id, CAST(len({TOK.format('text')}) AS INTEGER) AS n_tokens, CAST(len({CONTENT.format('text')}) AS INTEGER) AS n_content, CAST(len(list_distinct({CONTENT.format('text')})) AS INTEGER) AS n_distinct FROM documents")
def token_stats(spark, d):
    c = t.content_tokens(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t.tokens(F.col("text"))).alias("n_tokens"), F.size(c).alias("n_content"), F.size(F.array_distinct(c)).alias("n_distinct"))


@query(f"SELECT doc_id, CAST(len({SENTS.format('text')}) AS INTEGER) AS n_sentences, round(list_avg(list_filter(list_transform({CUT.format(TRIM.format('text'))}, lambda s: {N_TOK.format('s')}), lambda n: n > 0)), 6) AS avg_sentence_words FROM documents")
def sentence_stats(spark, d):
    return documents(spark, d).select("doc_id", F.size(t.sentences(F.col("text"))).alias("n_sentences"), F.round(t.average_sentence_length(F.col("text")), 6).alias("avg_sentence_words"))


LEAD = "array_to_string(list_slice(" + SENTS + ", 1, 3), ' ')"


@query(f"SELECT lang, count(*) AS n_docs, round(avg(CAST(len({TOK.format('lead')}) AS DOUBLE) / nullif(len({TOK.format('text')}), 0)), 6) AS compression FROM (SELECT lang, text, {LEAD.format('text')} AS lead FROM documents) GROUP BY lang")
def compression_by_lang(spark, d):
    c = measures.compression(t.lead(F.col("text")), F.col("text"))
    return documents(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(c), 6).alias("compression"))


def _rouge_sql(n: int) -> str:
    gram = "w[i]" if n == 1 else "w[i] || ' ' || w[i + 1]"
    return f"""WITH p AS (SELECT doc_id, {TOK.format("lead")} AS a, {TOK.format("text")} AS b FROM (SELECT doc_id, text, {LEAD.format("text")} AS lead FROM documents)),
      g AS (SELECT doc_id, side, {gram} AS g FROM (SELECT doc_id, side, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT doc_id, 0 AS side, a AS w FROM p UNION ALL SELECT doc_id, 1, b FROM p))),
      c AS (SELECT doc_id, g, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM g GROUP BY 1, 2),
      s AS (SELECT doc_id, sum(least(x, y)) AS o, sum(x) AS x, sum(y) AS y FROM c GROUP BY 1)
      SELECT p.doc_id, round(coalesce(CASE WHEN o > 0 THEN o / x END, 0.0), 6) AS prec, round(coalesce(CASE WHEN o > 0 THEN o / y END, 0.0), 6) AS rec, round(coalesce(CASE WHEN o > 0 THEN 2 * (o / x) * (o / y) / (o / x + o / y) END, 0.0), 6) AS f1 FROM p LEFT JOIN s ON p.doc_id = s.doc_id"""


def _rouge(spark, d, n):
    r = arrow.rouge_n(t.lead(F.col("text")), F.col("text"), n)
    return documents(spark, d).select("doc_id", r.alias("r")).select("doc_id", *(F.round(f"r.{a}", 6).alias(b) for a, b in (("precision", "prec"), ("recall", "rec"), ("f1", "f1"))))


@query(_rouge_sql(1))
def rouge1_lead3(spark, d):
    return _rouge(spark, d, 1)


@query(_rouge_sql(2))
def rouge2_lead3(spark, d):
    return _rouge(spark, d, 2)


@query(f"""WITH p AS (SELECT doc_id, len({TOK.format("lead")}) AS a, CAST(len({TOK.format("text")}) AS DOUBLE) AS b FROM (SELECT doc_id, text, {LEAD.format("text")} AS lead FROM documents))
  SELECT doc_id, CAST(CASE WHEN a > 0 THEN 1 ELSE 0 END AS DOUBLE) AS prec, round(CASE WHEN a > 0 THEN a / b ELSE 0.0 END, 6) AS rec, round(CASE WHEN a > 0 THEN 2 * (a / b) / (1 + a / b) ELSE 0.0 END, 6) AS f1 FROM p""")
def rouge_l_lead3(spark, d):
    """A lead's words are a subsequence of its text's, so SQL needs only their numbers; the operator searches for it."""
    r = documents(spark, d).select("doc_id", arrow.rouge_l(t.lead(F.col("text")), F.col("text")).alias("r"))
    return r.select("doc_id", *(F.round(f"r.{a}", 6).alias(b) for a, b in (("precision", "prec"), ("recall", "rec"), ("f1", "f1"))))


@query("SELECT doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def normalized_digest(spark, d):
    return documents(spark, d).select("doc_id", F.sha1(arrow.normalize(F.col("text"))).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(p) > 160 THEN rtrim(left(p, 159)) || '…' ELSE p END AS preview FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[*_#`>]+', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS p FROM documents)")
def previews(spark, d):
    return documents(spark, d).select("doc_id", t.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, CAST(greatest(1, round_even(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) / 200, 0)) AS INTEGER) AS minutes FROM documents")
def reading_time(spark, d):
    return documents(spark, d).select("doc_id", t.reading_minutes(F.col("text")).alias("minutes"))


@query(f"""SELECT doc_id, CAST(count(DISTINCT lower(s)) AS INTEGER) AS n FROM (SELECT doc_id, {TRIM.format("regexp_replace(s, '\\s+', ' ', 'g')")} AS s FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS s FROM documents)) WHERE {N_TOK.format("s")} BETWEEN 7 AND 45 GROUP BY doc_id""")
def quiz_sentence_counts(spark, d):
    return documents(spark, d).select("doc_id", F.size(t.quiz_sentences(F.col("text"))).alias("n")).where("n > 0")


@query(f"""SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM (SELECT doc_id, {TRIM.format("l")} AS l FROM (SELECT doc_id, unnest(string_split(text || chr(10) || 'Page ' || (doc_id % 90) || '/90' || chr(10) || '- ' || (doc_id % 2000) || ' -', chr(10))) AS l FROM documents))
  WHERE l <> '' AND length(l) <= 24 AND (regexp_matches(l, '(?i)^[\\s\\-–—•·\\[\\(<]*(trang|page|pg|tr|p)\\.?\\s*[0-9]{{1,4}}(\\s*(/|of|trên)\\s*[0-9]{{1,4}})?[\\s\\-–—•·\\]\\)>]*$') OR regexp_matches(l, '(?i)^\\s*[0-9]{{1,4}}\\s*(/|of|trên)\\s*[0-9]{{1,4}}\\s*$') OR regexp_matches(l, '^[\\s\\-–—•·\\[\\(<]*[0-9]{{1,3}}[\\s\\-–—•·\\]\\)>]*$')) GROUP BY doc_id""")
def page_number_lines(spark, d):
    """Lines that are page numbers, of texts with two more lines that may be some."""
    more = F.concat("text", F.lit("\nPage "), F.col("doc_id") % 90, F.lit("/90\n- "), F.col("doc_id") % 2000, F.lit(" -"))
    n = F.size(F.filter(F.split(more, "\n"), lambda x: t.is_page_number(x)))
    return documents(spark, d).select("doc_id", n.alias("n")).where("n > 0")


@query("""SELECT doc_id, sha1(regexp_replace(replace(text, '.', ' | '), '\\s+[|_^]\\s+', ' ', 'g')) AS digest FROM documents""")
def ocr_cleaned(spark, d):
    """Texts whose full stops became the bars that OCR leaves, cleaned."""
    return documents(spark, d).select("doc_id", F.sha1(t.clean_ocr_noise(F.replace("text", F.lit("."), F.lit(" | ")))).alias("digest"))


@query("""SELECT doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10) || '- **'), '[*_#`>]+', '', 'g'), '(?m)^\\s*[-•]\\s+', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents""")
def speech_cleaned(spark, d):
    """Texts whose sentences became list items, as they are to be spoken."""
    return documents(spark, d).select("doc_id", F.sha1(t.clean_for_speech(F.replace("text", F.lit(". "), F.lit(".\n- **")))).alias("digest"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(left(text, 60) || ' ' || n_chars), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\p{Nd}+', '#', 'g') AS sig FROM documents""")
def line_signatures(spark, d):
    return documents(spark, d).select("doc_id", t.signature(F.concat(F.left("text", F.lit(60)), F.lit(" "), "n_chars")).alias("sig"))


@query("""SELECT doc_id, source || ' lesson ' || doc_id AS stem, '.pdf' AS ext FROM documents""")
def file_names(spark, d):
    path = F.concat(F.lit("store://bucket/in.box/"), "source", F.lit("_-lesson__"), "doc_id", F.lit(".PDF"))
    return documents(spark, d).select("doc_id", t.stem(path).alias("stem"), t.extension(path).alias("ext"))


@query("SELECT doc_id, length(text) AS chars, CAST(least(120000, greatest(6000, ceil(length(text) / 10) + 500)) AS BIGINT) AS size FROM documents")
def chunk_plan(spark, d):
    """The size that a planned text is cut to, as the plan itself reports it."""
    return documents(spark, d).select("doc_id", F.length("text").cast("long").alias("chars"), arrow.plan_chunks(F.col("text"), 10).alias("p")).select("doc_id", "chars", "p.size")


@query()
def text_chunks(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(arrow.chunks(F.col("text"), 2000, 300)).alias("chunk_no", "chunk"))


@query()
def planned_chunks(spark, d):
    return documents(spark, d).select("doc_id", arrow.plan_chunks(F.col("text"), 10).alias("p")).select("doc_id", "p.truncated", F.size("p.chunks").alias("n_chunks"))


@query()
def paragraph_blocks(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(arrow.paragraph_chunks(F.split("text", "\n"), 3000)).alias("chunk_no", "chunk"))


N_WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda y: y <> ''))"


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {TRIM.format("x")}), lambda x: x <> '') AS p FROM documents),
  r AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: [{{'t': x, 'n': {N_WORDS.format("x")}}}]), lambda a, x: CASE WHEN a[-1].n + x[1].n > 150 THEN list_concat(a, x)
          ELSE list_concat(list_slice(a, 1, len(a) - 1), [{{'t': a[-1].t || ' ' || x[1].t, 'n': a[-1].n + x[1].n}}]) END) AS r FROM p WHERE len(p) > 0),
  m AS (SELECT doc_id, CASE WHEN len(r) > 1 AND r[-1].n < 40 THEN list_concat(list_slice(r, 1, len(r) - 2), [{{'t': r[-2].t || ' ' || r[-1].t, 'n': r[-2].n + r[-1].n}}]) ELSE r END AS m FROM r),
  k AS (SELECT doc_id, list_filter(m, lambda x: x.n >= 20) AS k FROM m)
  SELECT doc_id, unnest(range(len(k)))::INTEGER AS chunk_no, unnest(list_transform(k, lambda x: x.t)) AS chunk FROM k""")
def classifier_chunks(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(arrow.word_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), 150)).alias("chunk_no", "chunk"))


@query()
def speech_parts(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(arrow.speech_chunks(arrow.speech(F.col("text")), 700)).alias("part_no", "part"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 12000 THEN text ELSE array_to_string(list_transform([0, 1, 2, 3], lambda i: substr(text, CAST(floor((length(text) - 3000) / 3.0 * i) AS INTEGER) + 1, 3000)), chr(10) || chr(10)) END AS sample FROM documents""")
def sampled_text(spark, d):
    return documents(spark, d).select("doc_id", t.sample_parts(F.col("text")).alias("sample"))


@query()
def html_text(spark, d):
    return readers.html_pages(table(spark, d, "pages"))


HEADED = "text || chr(10) || '== Part ' || (doc_id % 9) || ' ==' || chr(10) || 'More of it.  ' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '=== Xem thêm ===' ELSE '= Cuối =' END || chr(10) || 'Links'"


@query(f"""WITH l AS (SELECT doc_id, regexp_split_to_array({HEADED}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS a FROM documents),
  h AS (SELECT doc_id, a, list_transform(a, lambda x: CASE WHEN regexp_full_match(x, '\\s*=+\\s*(.*?)\\s*=+\\s*') THEN regexp_extract(x, '^\\s*=+\\s*(.*?)\\s*=+\\s*$', 1) END) AS t FROM l),
  c AS (SELECT doc_id, a, t, list_position(list_transform(t, lambda x: coalesce(lower(x) IN ({", ".join(f"'{x}'" for x in v.CUT_SECTIONS)}), false)), true) AS cut FROM h)
  SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(range(1, CASE WHEN cut > 0 THEN cut ELSE len(a) + 1 END), lambda i: CASE WHEN t[i] IS NULL THEN regexp_replace(a[i], '\\s+$', '') ELSE chr(10) || t[i] || chr(10) END), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS article FROM c""")
def article_text(spark, d):
    """Texts with a heading more, half of them with one that ends the extract."""
    return documents(spark, d).select("doc_id", arrow.article_text(F.expr(HEADED.replace("chr(10)", "char(10)"))).alias("article"))


# --- extraction ----------------------------------------------------------------------------------------------------

D1 = f"""WITH {TOP_WORDS}, w AS (SELECT doc_id, unnest({TOK.format("text")}) AS keyword FROM documents), s AS (SELECT doc_id, domain, ord, count(*) AS score FROM w JOIN lex USING (keyword) GROUP BY ALL)"""


@query(D1 + " SELECT doc_id, domain, score FROM s")
def domain_scores(spark, d):
    return domain.score_domains(documents(spark, d), made_lexicon(spark, d)).select("doc_id", "domain", "score")


@query(D1 + f" SELECT d.doc_id, CASE WHEN {TRIM.format('d.text')} = '' THEN 'Unknown' ELSE coalesce(b.domain, 'General/Unknown') END AS domain FROM documents d LEFT JOIN (SELECT doc_id, domain, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r FROM s) b ON d.doc_id = b.doc_id AND r = 1")
def domain_best(spark, d):
    return domain.detect_domain(documents(spark, d), made_lexicon(spark, d)).select("doc_id", "domain")


@query(D1 + " SELECT doc_id, CAST(r AS INTEGER) AS rank, domain FROM (SELECT doc_id, domain, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain DESC) AS r FROM s) WHERE r IN (2, 3)")
def domain_alternatives(spark, d):
    return domain.alternatives(domain.score_domains(documents(spark, d), made_lexicon(spark, d)))


@query(D1 + ", k AS (SELECT doc_id, keyword, count(*) AS n FROM w JOIN lex USING (keyword) GROUP BY ALL) SELECT doc_id, CAST(r AS INTEGER) AS rank, keyword FROM (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS r FROM k) WHERE r <= 10")
def top_concepts(spark, d):
    terms = F.array(*map(F.lit, top_words(spark, d)))
    return documents(spark, d).select("doc_id", F.posexplode(t.top_concepts(F.col("text"), terms)).alias("rank", "keyword")).withColumn("rank", F.col("rank") + 1)


ACRONYMS = "SELECT doc_id, a AS acronym, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_-]+')) AS a FROM documents) WHERE regexp_full_match(a, '[A-Z][A-Z0-9]{1,5}') GROUP BY 1, 2"


@query(ACRONYMS)
def acronym_counts(spark, d):
    return documents(spark, d).select("doc_id", F.explode(t.acronym_uses(F.col("text"))).alias("acronym")).groupBy("doc_id", "acronym").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, acronym FROM ({ACRONYMS}) WHERE n >= 2")
def undefined_acronyms(spark, d):
    return documents(spark, d).select("doc_id", F.explode(t.undefined_abbreviations(F.col("text"), F.array().cast("array<string>"))).alias("acronym"))


@query()
def abbreviations(spark, d):
    return documents(spark, d).select("doc_id", F.explode(arrow.abbreviations(F.concat("text", F.lit(" It says Natural Language Processing (NLP) and GPU (Graphics Processing Unit).")))).alias("p")).select("doc_id", "p.*")


_PHRASE_STOP = ", ".join(f"'{w}'" for w in v.PHRASE_STOP)
TERMS = f"""w AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w, regexp_extract_all(text, '\\p{{L}}+|[.!?:;\\n]') AS f FROM documents),
  m AS (SELECT doc_id, text, w, chr(2) || ' ' || array_to_string(list_transform(f, lambda x: CASE WHEN regexp_full_match(x, '[.!?:;\\n]') THEN chr(2) WHEN regexp_full_match(x, '\\p{{Lu}}[^\\p{{Lu}}\\p{{Lt}}]*\\p{{Ll}}[^\\p{{Lu}}\\p{{Lt}}]*') AND NOT lower(x) IN ({_PHRASE_STOP}) THEN x ELSE chr(1) END), ' ') AS line FROM w),
  r AS (SELECT doc_id, text, w, list_transform(list_filter(regexp_extract_all(line, '(?:\\x02 )?\\p{{L}}+(?: \\p{{L}}+)*'), lambda x: NOT (starts_with(x, chr(2)) AND NOT contains(substr(x, 3), ' '))), lambda x: replace(x, chr(2) || ' ', '')) AS runs FROM m),
  t AS (SELECT doc_id, text, w, list_distinct(list_concat(list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{{2,}}|[A-Z]?[a-z]+[A-Z][a-z]*[A-Za-z]*')), list_filter(runs, lambda x: length(x) > 3), regexp_extract_all(text, '\\b[a-zA-Z0-9_]+[:/][a-zA-Z0-9_:/]+\\b'))) AS terms FROM r)"""


@query(f"WITH {TERMS} SELECT doc_id, unnest(terms) AS term FROM t")
def terminology(spark, d):
    return documents(spark, d).select("doc_id", F.explode(t.terminology(F.col("text"))).alias("term"))


_UPPER = "(upper({0}) = {0} AND lower({0}) <> {0})"
_TERM_STOP = ", ".join(f"'{w}'" for w in v.TERM_STOP)


@query(f"""WITH {TERMS}, x AS (SELECT doc_id, unnest(terms) AS x FROM t),
  g AS (SELECT doc_id, lower(x) AS k, min(x) FILTER ({_UPPER.format("x")} AND length(x) BETWEEN 2 AND 5 AND NOT contains(x, ' ')) AS acronym, min(x) FILTER (NOT {_UPPER.format("x")}) AS mixed FROM x GROUP BY ALL),
  u AS (SELECT doc_id, lower(y) AS k, count(*) AS n, count(*) FILTER (regexp_matches(y, '^\\p{{Lu}}')) AS c FROM (SELECT doc_id, unnest(w) AS y FROM w) GROUP BY ALL),
  o AS (SELECT doc_id, k, list_filter(range(1, len(p)), lambda i: NOT regexp_matches(p[i], '[\\p{{L}}\\p{{N}}_]$') AND NOT regexp_matches(p[i + 1], '^[\\p{{L}}\\p{{N}}_]') AND (i = 1 OR p[i] <> '')) AS hit, p, text
        FROM (SELECT g.doc_id, g.k, string_split(lower(text), g.k) AS p, text FROM g JOIN w ON g.doc_id = w.doc_id WHERE regexp_matches(g.k, '[:/]'))),
  e AS (SELECT doc_id, k, n, c FROM u UNION ALL SELECT doc_id, k, len(hit), len(list_filter(hit, lambda i: regexp_matches(substr(text, CAST(list_sum(list_transform(list_slice(p, 1, i), lambda y: length(y))) AS BIGINT) + (i - 1) * length(k) + 1, 1), '^\\p{{Lu}}'))) FROM o)
  SELECT g.doc_id, coalesce(acronym, mixed, upper(left(g.k, 1)) || substr(g.k, 2)) AS term FROM g LEFT JOIN e ON g.doc_id = e.doc_id AND g.k = e.k
  WHERE len(string_split(g.k, ' ')) <= 4 AND NOT g.k IN ({_TERM_STOP}) AND (contains(g.k, ' ') OR acronym IS NOT NULL OR (n >= 2 AND c >= 0.7 * n))""")
def cleaned_terms(spark, d):
    return documents(spark, d).select("doc_id", F.explode(t.clean_terms(t.terminology(F.col("text")), F.col("text"))).alias("term"))


@query(f"""WITH {TOP_WORDS}, s AS (SELECT doc_id, unnest(regexp_extract_all(text, '([^\\p{{L}}\\p{{N}}_]*)([\\p{{L}}\\p{{N}}_]+)', 1)) AS gap, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS form, unnest(range(1, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) + 1)) AS i FROM documents),
  u AS (SELECT doc_id, domain, keyword, form, i, NOT ((i = 1 AND gap = '') OR regexp_matches(gap, '(\\n\\s*|[.!?:]\\s+)$')) AS inside FROM s JOIN lex ON lower(form) = keyword),
  d AS (SELECT doc_id, domain, count(*) AS score FROM u GROUP BY ALL), b AS (SELECT doc_id, max(score) AS top FROM d GROUP BY doc_id),
  f AS (SELECT u.doc_id, keyword, form, count(*) AS n, count(*) FILTER (inside) AS n_in, min(i) AS first, min(i) FILTER (inside) AS first_in, {_UPPER.format("form")} AS up FROM u JOIN d ON u.doc_id = d.doc_id AND u.domain = d.domain JOIN b ON b.doc_id = u.doc_id WHERE score >= 0.25 * top GROUP BY ALL)
  SELECT doc_id, coalesce(arg_min(form, (form <> lower(form) AND NOT up, -n_in, first_in)) FILTER (n_in > 0), arg_min(form, (-n, first)) FILTER (up), keyword) AS term FROM f GROUP BY doc_id, keyword""")
def lexicon_terms(spark, d):
    return domain.lexicon_terms(documents(spark, d), made_lexicon(spark, d)).select("doc_id", F.explode("terms").alias("term"))


@query()
def formulas(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(arrow.formulas(F.split("text", "\n"))).alias("pos", "formula"))


@query()
def formula_lines(spark, d):
    lines = F.split("text", "\n")
    return documents(spark, d).select("doc_id", F.size(F.filter(lines, t.looks_like_formula)).alias("n_formula"), F.size(F.filter(lines, t.looks_like_code)).alias("n_code"))


# Signs are doubled, so that two numbers may share the one between them.
TWICE = "regexp_replace(text || ' 16 GB, 3,5 kg and 20°C', '([^\\p{L}\\p{N}_.])', '\\1\\1', 'g')"
UNIT = "'(?:^|[^\\p{L}\\p{N}_.])(\\p{Nd}+(?:(?:\\.|,,)\\p{Nd}+)?)(?:\\s\\s)?(" + "|".join(v.UNITS).replace("°C", "°°C") + ")(?:[^A-Za-z]|$)'"


@query(f"SELECT doc_id, unnest(list_distinct(list_transform(list_zip(regexp_extract_all({TWICE}, {UNIT}, 1), regexp_extract_all({TWICE}, {UNIT}, 2)), lambda p: replace(p[1], ',,', ',') || ' ' || replace(p[2], '°°C', '°C')))) AS unit FROM documents")
def units(spark, d):
    return documents(spark, d).select("doc_id", F.explode(t.units(F.concat("text", F.lit(" 16 GB, 3,5 kg and 20°C")))).alias("unit"))


@query()
def domain_profiles(spark, d):
    docs = documents(spark, d).select("doc_id", "text", F.split("text", "\n").alias("paragraphs"))
    lex = made_lexicon(spark, d)
    return domain.profile(pipeline.analyze(docs, lex), lex)


# --- ranking, grounding, measures ----------------------------------------------------------------------------------

TFIDF = f"""WITH s AS (SELECT doc_id, {SENTS.format("text")} AS s FROM documents), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x, unnest(range(len(s))) AS pos FROM s),
  k AS (SELECT doc_id, n, pos, unnest({CONTENT.format("x")}) AS token FROM e), tf AS (SELECT doc_id, n, pos, token, count(*) AS tf FROM k GROUP BY ALL),
  w AS (SELECT doc_id, pos, token, tf * (ln((1.0 + n) / (1.0 + count(*) OVER (PARTITION BY doc_id, token))) + 1) AS w FROM tf)"""


@query(TFIDF + " SELECT doc_id, count(*) AS n_rows, round(sum(w), 4) AS total FROM w GROUP BY doc_id")
def sentence_tfidf(spark, d):
    return rank.sentence_tfidf(documents(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("w"), 4).alias("total"))


@query(TFIDF + ", u AS (SELECT doc_id, pos, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, pos)) AS u FROM w), e2 AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.u * b.u) AS w FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.token = b.token AND a.pos < b.pos GROUP BY ALL) SELECT doc_id, count(*) AS n_edges, round(sum(w), 4) AS total FROM e2 GROUP BY doc_id")
def similarity_edges(spark, d):
    return rank.similarity_edges(documents(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("w"), 4).alias("total"))


@query()
def textrank_top3(spark, d):
    return rank.textrank(documents(spark, d), 3)


@query()
def textrank_boosted(spark, d):
    docs = documents(spark, d).withColumn("terms", F.array(*map(F.lit, top_words(spark, d))))
    return rank.textrank(docs, 3, "terms")


def _split_docs(spark, d):
    s = t.sentences(F.col("text"))
    return documents(spark, d).select("doc_id", F.array_join(F.slice(s, 1, 3), " ").alias("summary"), F.array_join(F.slice(s, F.lit(4), F.greatest(F.size(s) - 3, F.lit(0))), " ").alias("source"))


@query(f"""WITH s AS (SELECT doc_id, {SENTS.format("text")} AS s FROM documents), q AS (SELECT doc_id, unnest(list_slice(s, 1, 3)) AS x, unnest(range(least(3, len(s)))) AS pos FROM s),
  src AS (SELECT doc_id, list_slice(s, 4, len(s)) AS s FROM s), win AS (SELECT doc_id, greatest(1, len(s) - 2) AS n, s FROM src WHERE len(s) > 0),
  wt AS (SELECT doc_id, n, i, unnest({CONTENT.format("array_to_string(list_slice(s, i, i + 2), ' ')")}) AS token FROM (SELECT doc_id, n, s, unnest(range(1, n + 1)) AS i FROM win)),
  tf AS (SELECT doc_id, n, i, token, count(*) AS tf FROM wt GROUP BY ALL), df AS (SELECT doc_id, token, count(*) AS df FROM tf GROUP BY ALL),
  v AS (SELECT tf.doc_id, i, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (doc_id, token)), nv AS (SELECT doc_id, i, sqrt(sum(w * w)) AS nv FROM v GROUP BY ALL),
  qt AS (SELECT doc_id, pos, unnest({CONTENT.format("x")}) AS token FROM q), qf AS (SELECT doc_id, pos, token, count(*) AS tf FROM qt GROUP BY ALL),
  qw AS (SELECT qf.doc_id, pos, qf.token, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1) AS w FROM qf JOIN win ON qf.doc_id = win.doc_id LEFT JOIN df ON qf.doc_id = df.doc_id AND qf.token = df.token),
  nq AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS nq FROM qw GROUP BY ALL),
  dots AS (SELECT qw.doc_id, pos, i, sum(qw.w * v.w) AS dot FROM qw JOIN v ON qw.doc_id = v.doc_id AND qw.token = v.token GROUP BY ALL),
  best AS (SELECT dots.doc_id, dots.pos, max(dot / (nq * nv)) AS score FROM dots JOIN nq ON dots.doc_id = nq.doc_id AND dots.pos = nq.pos JOIN nv ON dots.doc_id = nv.doc_id AND dots.i = nv.i GROUP BY ALL)
  SELECT q.doc_id, CAST(q.pos AS INTEGER) AS pos, round(CASE WHEN win.doc_id IS NULL THEN 0.0 WHEN nq IS NULL THEN 1.0 ELSE least(1.0, coalesce(score, 0.0)) END, 6) AS score FROM q LEFT JOIN win ON q.doc_id = win.doc_id LEFT JOIN nq ON q.doc_id = nq.doc_id AND q.pos = nq.pos LEFT JOIN best b ON q.doc_id = b.doc_id AND q.pos = b.pos""")
def grounding_scores(spark, d):
    s = t.sentences(F.col("text"))
    g = arrow.grounding(F.slice(s, 1, 3), F.slice(s, F.lit(4), F.greatest(F.size(s) - 3, F.lit(0))))
    return documents(spark, d).select("doc_id", F.posexplode(g).alias("pos", "score")).withColumn("score", F.round("score", 6))


NUM = "regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)?')"
SPLIT = f"(SELECT doc_id, array_to_string(list_slice(s, 1, 3), ' ') AS a, array_to_string(list_slice(s, 4, len(s)), ' ') AS b FROM (SELECT doc_id, {SENTS.format('text')} AS s FROM documents))"


@query(f"SELECT doc_id, CAST(len(x) AS INTEGER) AS total, round(len(list_filter(x, lambda n: list_contains(y, n))) / CAST(len(x) AS DOUBLE), 6) AS rate, array_to_string(list_sort(list_distinct(list_filter(x, lambda n: NOT list_contains(y, n)))), ',') AS unsupported FROM (SELECT doc_id, {NUM.format('a')} AS x, {NUM.format('b')} AS y FROM {SPLIT}) WHERE len(x) > 0")
def number_support(spark, d):
    n = measures.number_preservation(F.col("summary"), F.col("source"))
    rows = _split_docs(spark, d).select("doc_id", n.alias("n")).where("n is not null")
    return rows.select("doc_id", "n.total", F.round("n.rate", 6).alias("rate"), F.array_join("n.unsupported", ",").alias("unsupported"))


@query(f"WITH {TOP_WORDS}, l AS (SELECT list(keyword) AS ks FROM lex) SELECT doc_id, CAST(len(list_filter(ks, lambda k: contains(lower(lead), k))) AS INTEGER) AS kept, CAST(len(ks) AS INTEGER) AS total FROM (SELECT doc_id, {LEAD.format('text')} AS lead FROM documents), l")
def term_preservation(spark, d):
    terms = F.array(*map(F.lit, top_words(spark, d)))
    return documents(spark, d).select("doc_id", measures.term_preservation(t.lead(F.col("text")), terms).alias("p")).select("doc_id", "p.kept", "p.total")


REPORT = """m AS (SELECT doc_id, text, 'lead1' AS method, array_to_string(list_slice(s, 1, 1), ' ') AS lead FROM s UNION ALL SELECT doc_id, text, 'lead3', array_to_string(list_slice(s, 1, 3), ' ') FROM s)"""


@query(f"WITH s AS (SELECT doc_id, text, {SENTS.format('text')} AS s FROM documents), {REPORT}, r AS (SELECT method, CAST(len({TOK.format('lead')}) AS DOUBLE) / nullif(len({TOK.format('text')}), 0) AS c, list_avg(list_filter(list_transform({CUT.format(TRIM.format('lead'))}, lambda s: {N_TOK.format('s')}), lambda n: n > 0)) AS a FROM m) SELECT method, count(*) AS n_docs, round(avg(c), 6) AS compression, round(avg(a), 6) AS avg_sentence_words, count(a) AS avg_sentence_words_n FROM r GROUP BY method")
def method_report(spark, d):
    empty = F.array().cast("array<string>")
    pairs = documents(spark, d).select("doc_id", F.col("text").alias("source"), empty.alias("terms"), empty.alias("formulas"), F.explode(F.create_map(F.lit("lead1"), t.lead(F.col("text"), 1), F.lit("lead3"), t.lead(F.col("text"), 3))).alias("method", "summary"))
    g = measures.summarize_rows(measures.evaluate(pairs))
    return g.select("method", "n_docs", F.round("compression", 6).alias("compression"), F.round("avg_sentence_words", 6).alias("avg_sentence_words"), "avg_sentence_words_n")


@query()
def validated_summaries(spark, d):
    pairs = _split_docs(spark, d).withColumn("abbreviations", arrow.abbreviations(F.col("source")))
    return measures.validate(pairs).drop("abbreviation_conflicts", "ungrounded_sentences")


@query()
def reading_integrity(spark, d):
    docs = documents(spark, d).select("doc_id", t.clean_for_speech(F.col("text")).alias("summary"), F.col("text").alias("source"), t.terminology(F.col("text")).alias("terms"))
    return measures.reading_integrity(docs)


# --- layout and files ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, digest FROM (SELECT doc_id, sha1(text) AS digest, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def doc_dedupe_sha1(spark, d):
    files = documents(spark, d).select(F.lit(0).alias("batch_id"), F.col("doc_id").alias("pos"), F.array("text").alias("paragraphs"))
    return layout.drop_copies(files).select(F.col("pos").alias("doc_id"), "digest")


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
  f AS (SELECT source, doc_id, t, i, row_number() OVER (PARTITION BY source, doc_id ORDER BY i) AS a, row_number() OVER (PARTITION BY source, doc_id ORDER BY i DESC) AS b FROM l WHERE regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> ''),
  s AS (SELECT DISTINCT source, doc_id, regexp_replace(regexp_replace(regexp_replace(lower(t), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '[0-9]+', '#', 'g') AS sig FROM f WHERE a <= 2 OR b <= 2),
  p AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source), c AS (SELECT source, sig, count(*) AS k FROM s WHERE sig <> '' AND length(sig) <= 120 GROUP BY ALL)
  SELECT source, sig FROM c JOIN p USING (source) WHERE n >= 3 AND k >= greatest(3, ceil(n * 0.01))""")
def repeated_edge_lines(spark, d):
    docs = documents(spark, d).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    rows = layout.edge_lines(docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "line_no", "text")).where("edge")
    pages = documents(spark, d).groupBy(F.col("source").alias("doc_id")).agg(F.count_distinct("doc_id").alias("n_pages"))
    return layout.repeated(rows, pages, 3, 0.01).select(F.col("doc_id").alias("source"), "sig")


SIG = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '[0-9]+', '#', 'g')"
PAGE_NO = """(length({0}) <= 24 AND (regexp_matches({0}, '(?i)^[\\s\\-–—•·\\[\\(<]*(trang|page|pg|tr|p)\\.?\\s*[0-9]{{1,4}}(\\s*(/|of|trên)\\s*[0-9]{{1,4}})?[\\s\\-–—•·\\]\\)>]*$') OR regexp_matches({0}, '(?i)^\\s*[0-9]{{1,4}}\\s*(/|of|trên)\\s*[0-9]{{1,4}}\\s*$'){1}))"""
BARE_NO = " OR regexp_matches({0}, '^[\\s\\-–—•·\\[\\(<]*[0-9]{{1,3}}[\\s\\-–—•·\\]\\)>]*$')"


def page_no(x: str, strict: bool = False) -> str:
    return PAGE_NO.format(x, "" if strict else BARE_NO.format(x))


@query(f"""WITH b AS (SELECT source AS doc_id, doc_id AS page_no, 0 AS block_pos, 10.0 AS y0, 30.0 AS y1, 'Report of ' || source || ', part ' || doc_id AS text, 0 AS kind FROM documents
    UNION ALL SELECT source, doc_id, 1, 40.0, CASE WHEN doc_id % 2 = 0 THEN 60.0 ELSE 300.0 END, left(text, 80), 0 FROM documents UNION ALL SELECT source, doc_id, 2, 300.0, 320.0, 'Report of ' || source || ', part 1', 0 FROM documents
    UNION ALL SELECT source, doc_id, 3, 760.0, 780.0, CASE WHEN doc_id % 3 = 0 THEN 'See also ' || md5(text) ELSE '- ' || (doc_id % 90) || ' -' END, 0 FROM documents UNION ALL SELECT source, doc_id, 4, 100.0, 200.0, 'image', 1 FROM documents),
  e AS (SELECT *, (y1 <= 72 OR y0 >= 728) AND {TRIM.format("text")} <> '' AS edge, {SIG.format("text")} AS sig, {TRIM.format("text")} AS s FROM b),
  c AS (SELECT doc_id, sig, count(DISTINCT page_no) AS n FROM e WHERE kind = 0 AND edge AND sig <> '' AND length(sig) <= 120 GROUP BY ALL), p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM b GROUP BY doc_id),
  gone AS (SELECT c.doc_id, sig FROM c JOIN p ON c.doc_id = p.doc_id WHERE pages >= 3 AND n >= greatest(3, ceil(0.4 * pages)))
  SELECT e.doc_id, page_no, CAST(block_pos AS INTEGER) AS block_pos, text FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.sig = gone.sig WHERE kind = 0 AND NOT (edge AND (gone.sig IS NOT NULL OR {page_no("s")}))""")
def pdf_block_filter(spark, d):
    """Blocks made of documents, a source being a file and a document a page, without headers, footers, page numbers and images."""

    def block(pos, y0, y1, text, kind=0):
        return F.struct(F.lit(pos).alias("block_pos"), F.lit(y0).alias("y0"), y1.alias("y1"), text.alias("text"), F.lit(kind).alias("block_type"))

    i = F.col("doc_id")
    title = lambda n: F.concat(F.lit("Report of "), "source", F.lit(", part "), n)
    foot = F.when(i % 3 == 0, F.concat(F.lit("See also "), F.md5("text"))).otherwise(F.concat(F.lit("- "), (i % 90).cast("string"), F.lit(" -")))
    made = F.array(
        block(0, 10.0, F.lit(30.0), title(i.cast("string"))), block(1, 40.0, F.when(i % 2 == 0, 60.0).otherwise(300.0), F.left("text", F.lit(80))),
        block(2, 300.0, F.lit(320.0), title(F.lit("1"))), block(3, 760.0, F.lit(780.0), foot), block(4, 100.0, F.lit(200.0), F.lit("image"), 1),
    )
    rows = documents(spark, d).select(F.col("source").alias("doc_id"), i.alias("page_no"), F.lit(800.0).alias("page_h"), F.inline(made))
    return layout.filter_furniture(rows).select("doc_id", "page_no", "block_pos", "text")


PAGE_TEXT = "'Notes of ' || source || chr(10) || text || chr(10) || 'Page ' || (doc_id % 50)"


@query(f"""WITH l AS (SELECT source, doc_id, unnest(string_split({PAGE_TEXT}, chr(10))) AS t, unnest(range(len(string_split({PAGE_TEXT}, chr(10))))) AS i FROM documents),
  f AS (SELECT *, {TRIM.format("t")} AS s, sum(CAST({TRIM.format("t")} <> '' AS INTEGER)) OVER (PARTITION BY source, doc_id ORDER BY i) AS a, sum(CAST({TRIM.format("t")} <> '' AS INTEGER)) OVER (PARTITION BY source, doc_id ORDER BY i DESC) AS b FROM l),
  e AS (SELECT *, s <> '' AND (a <= 2 OR b <= 2) AS edge, {SIG.format("t")} AS sig FROM f), p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
  c AS (SELECT source, sig, count(DISTINCT doc_id) AS n FROM e WHERE edge AND sig <> '' AND length(sig) <= 120 GROUP BY ALL), gone AS (SELECT c.source, sig FROM c JOIN p ON c.source = p.source WHERE pages >= 3 AND n >= greatest(3, ceil(0.4 * pages)))
  SELECT e.source AS doc_id, doc_id AS page_no, sha1({TRIM.format("coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (NOT (edge AND (gone.sig IS NOT NULL OR " + page_no("s") + "))), '')")}) AS digest FROM e LEFT JOIN gone ON e.source = gone.source AND e.sig = gone.sig GROUP BY ALL""")
def page_lines_stripped(spark, d):
    """Documents as pages of their source, without the lines at their edges that repeat or are page numbers."""
    text = F.concat(F.lit("Notes of "), "source", F.lit("\n"), "text", F.lit("\nPage "), (F.col("doc_id") % 50).cast("string"))
    lines = documents(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    return layout.strip_page_lines(lines).select("doc_id", "page_no", F.sha1("text").alias("digest"))


NUMBERED = "list_concat(string_split(text, '. '), ['12', 'Page ' || (doc_id % 90), 'Total' || chr(10) || 'p. 7' || chr(10) || '42', 'tr. 3/9' || chr(10) || '4 of 5'])"


@query(f"""WITH p AS (SELECT doc_id, {NUMBERED} AS a FROM documents), l AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM p),
  k AS (SELECT *, string_split(regexp_replace(regexp_replace(x, '\\n$', ''), '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS ls FROM l),
  r AS (SELECT *, {TRIM.format("array_to_string(list_filter(ls, lambda y: NOT coalesce(" + TRIM.format("y") + " <> '' AND " + page_no(TRIM.format("y"), True) + ", false)), chr(10))")} AS rest FROM k)
  SELECT doc_id, count(*) AS n, sha1(string_agg(CASE WHEN len(ls) <= 1 THEN x ELSE rest END, '|' ORDER BY i)) AS digest FROM r WHERE CASE WHEN len(ls) <= 1 THEN NOT ({TRIM.format("x")} <> '' AND {page_no(TRIM.format("x"))}) ELSE rest <> '' END GROUP BY doc_id""")
def page_number_paragraphs(spark, d):
    """Sentences as paragraphs, with some that are or hold page numbers, without those."""
    more = F.array(F.lit("12"), F.concat(F.lit("Page "), (F.col("doc_id") % 90).cast("string")), F.lit("Total\np. 7\n42"), F.lit("tr. 3/9\n4 of 5"))
    kept = t.drop_page_numbers(F.concat(F.split("text", r"\. "), more))
    return documents(spark, d).select("doc_id", F.size(kept).cast("long").alias("n"), F.sha1(F.array_join(kept, "|")).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
  b AS (SELECT doc_id, i, regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS t FROM l), f AS (SELECT * FROM b WHERE t <> ''),
  m AS (SELECT doc_id, i, t, coalesce(lag(CAST(regexp_matches(t, '[.:?!][''")]*$') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i), 0) AS s FROM f), g AS (SELECT doc_id, i, t, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS para_pos FROM m)
  SELECT doc_id, para_pos, sha1(string_agg(t, ' ' ORDER BY i)) AS digest FROM g GROUP BY doc_id, para_pos""")
def paragraph_islands(spark, d):
    blocks = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return layout.merge_blocks(blocks).select("doc_id", "para_pos", F.sha1("text").alias("digest"))


@query("SELECT source, count(*) AS n_cases, count(l.doc_id) AS n_with_reference FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source")
def case_pairs(spark, d):
    docs = documents(spark, d).select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.array("text").alias("paragraphs"))
    refs = table(spark, d, "labels").select("doc_id").distinct().select(F.lit(None).cast("string").alias("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".ref.txt")).alias("path"), F.array(F.lit("x")).alias("paragraphs"))
    cases = readers.benchmark_cases(docs.select("path", "paragraphs").union(refs.select("path", "paragraphs")))
    both = cases.join(docs.select("path", "source"), "path")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_cases"), F.count("reference").alias("n_with_reference"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents),
  f AS (SELECT source || '-' || (n // 10) AS batch_id, n % 10 AS pos, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: {TRIM.format("x")}), lambda x: x <> '') AS p FROM r),
  k AS (SELECT batch_id, pos, p, len(p) > 0 AND row_number() OVER (PARTITION BY batch_id, array_to_string(p, chr(10)) ORDER BY pos) = 1 AS kept FROM f)
  SELECT batch_id, CAST(sum(len(p)) FILTER (kept) + CASE WHEN count(*) FILTER (kept) > 1 THEN count(*) FILTER (kept) ELSE 0 END AS INTEGER) AS n_paragraphs, CASE WHEN count(*) FILTER (kept) > 1 THEN 'Gộp ' || count(*) FILTER (kept) || ' file' ELSE 'txt' END AS source_type,
    CAST(count(*) FILTER (NOT kept) AS INTEGER) AS n_warnings, CAST(count(*) FILTER (kept) AS INTEGER) AS n_sources, CAST(NULL AS VARCHAR) AS error FROM k GROUP BY batch_id""")
def merged_sources(spark, d):
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = documents(spark, d).withColumn("n", n)
    files = rows.select(F.concat_ws("-", "source", F.floor(F.col("n") / 10).cast("string")).alias("batch_id"), (F.col("n") % 10).alias("pos"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = layout.merge_files(readers.parse_files(files, pdf=False))
    return out.select("batch_id", F.size("paragraphs").alias("n_paragraphs"), "source_type", F.size("warnings").alias("n_warnings"), F.size("sources").alias("n_sources"), "error")


@query("SELECT doc_id || '.docx' AS name, CAST(1 + len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')) AS INTEGER) AS n_paragraphs, CAST(NULL AS VARCHAR) AS error FROM documents")
def docx_round_trip(spark, d):
    made = sinks.export_docx(documents(spark, d).select("doc_id", F.col("source").alias("title"), F.col("text").alias("summary")))
    read = readers.parse_files(made.select(F.concat("doc_id", F.lit(".docx")).alias("path"), "content"), pdf=False)
    return read.select("name", F.size("paragraphs").alias("n_paragraphs"), "error")


# --- statistics ----------------------------------------------------------------------------------------------------

PREDS = """p AS (SELECT d.doc_id AS pos, source || '-' || quality AS grp, CAST(quality AS VARCHAR) AS label, m.method, CASE m.method WHEN 'long' THEN CASE WHEN n_chars > 600 THEN '1' ELSE '0' END ELSE CASE WHEN d.doc_id % 3 = 0 THEN '0' ELSE '1' END END AS pred, (n_chars % 101) / 100.0 AS conf
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('long'), ('third')) m(method))"""


def predictions(spark, d):
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("method", F.explode(F.array(F.lit("long"), F.lit("third"))))
    pred = F.when(F.col("method") == "long", F.when(F.col("n_chars") > 600, "1").otherwise("0")).otherwise(F.when(F.col("doc_id") % 3 == 0, "0").otherwise("1"))
    return rows.select(F.col("doc_id").alias("pos"), F.concat_ws("-", "source", F.col("quality").cast("string")).alias("grp"), F.col("quality").cast("string").alias("label"), "method", pred.alias("pred"), (F.col("n_chars") % 101 / 100.0).alias("conf"))


@query(f"WITH {PREDS} SELECT method, label, pred, count(*) AS n FROM p GROUP BY ALL")
def confusion_counts(spark, d):
    return stats.confusion(predictions(spark, d))


@query(f"WITH {PREDS} SELECT method, label, count(*) FILTER (pred = '0') AS pred_0, count(*) FILTER (pred = '1') AS pred_1 FROM p GROUP BY ALL")
def confusion_matrix(spark, d):
    return stats.confusion_matrix(predictions(spark, d), ["0", "1"]).withColumnsRenamed({"0": "pred_0", "1": "pred_1"})


CLASSES = f"""WITH {PREDS}, c AS (SELECT method, cls, count(*) FILTER (label = cls) AS support, count(*) FILTER (pred = cls) AS predicted, count(*) FILTER (label = cls AND pred = cls) AS hits FROM p, (VALUES ('0'), ('1')) k(cls) GROUP BY ALL),
  x AS (SELECT method, cls, support, coalesce(hits / nullif(predicted, 0), 0.0) AS pr, coalesce(hits / nullif(support, 0), 0.0) AS re, coalesce(2 * hits / nullif(support + predicted, 0), 0.0) AS f FROM c)"""


@query(CLASSES + " SELECT method, cls, round(pr, 6) AS prec, round(re, 6) AS rec, round(f, 6) AS f1, support FROM x")
def class_metrics(spark, d):
    return stats.class_metrics(predictions(spark, d)).select("method", "cls", F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("rec"), F.round("f1", 6).alias("f1"), "support")


@query(CLASSES + ", a AS (SELECT method, count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS acc FROM p GROUP BY ALL) SELECT a.method, n, round(acc, 6) AS accuracy, round(avg(f), 6) AS macro_f1 FROM a JOIN x ON a.method = x.method GROUP BY a.method, n, acc")
def macro_f1(spark, d):
    return stats.accuracy(predictions(spark, d)).select("method", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


VOTES = f"""WITH {PREDS}, g AS (SELECT method, grp, label, pred, count(*) AS n, min(pos) AS first FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY method, grp ORDER BY n DESC, first) AS r, sum(n) OVER (PARTITION BY method, grp) AS total FROM g), v AS (SELECT method, grp, label, pred, n / total AS share, label = pred AS ok FROM r WHERE r = 1)"""


@query(VOTES + " SELECT method, grp, label, pred, round(share, 6) AS share, ok FROM v")
def doc_votes(spark, d):
    return stats.votes(predictions(spark, d)).withColumn("share", F.round("share", 6))


@query(VOTES + ", k AS (SELECT method, count(*) FILTER (ok) AS k, count(*) AS n FROM v GROUP BY method), w AS (SELECT method, k, n, k / CAST(n AS DOUBLE) AS p FROM k) SELECT method, k, n, round(greatest(0.0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1.0, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM w")
def wilson_ci(spark, d):
    return stats.wilson_intervals(stats.votes(predictions(spark, d))).select("method", "k", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(VOTES + ", m AS (SELECT x.method AS a, y.method AS b, count(*) FILTER (x.ok AND NOT y.ok) AS only_a, count(*) FILTER (y.ok AND NOT x.ok) AS only_b FROM v x JOIN v y ON x.grp = y.grp AND x.method < y.method GROUP BY ALL) SELECT a, b, only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda k: exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))))), 4) END AS p FROM m")
def mcnemar(spark, d):
    return stats.mcnemar(stats.votes(predictions(spark, d)))


BINS = f"WITH {PREDS}, b AS (SELECT method, CAST(least(floor(conf * 5), 4) AS INTEGER) AS bin, count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS a, avg(conf) AS c FROM p GROUP BY ALL)"


@query(BINS + " SELECT method, bin, n, round(a, 6) AS accuracy, round(c, 6) AS mean_conf FROM b")
def ece_bins(spark, d):
    b = stats.calibration(predictions(spark, d))
    return b.select("method", "bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_conf", 6).alias("mean_conf"))


@query(BINS + " SELECT method, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY method")
def ece(spark, d):
    return stats.expected_calibration_error(stats.calibration(predictions(spark, d))).withColumn("ece", F.round("ece", 6))


@query(f"WITH {PREDS} SELECT method, threshold, round(count(*) FILTER (conf >= threshold) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(avg(CASE WHEN conf >= threshold THEN CASE WHEN label = pred THEN 1.0 ELSE 0.0 END END), 6) AS accuracy FROM p, (VALUES (CAST(0.4 AS DOUBLE)), (0.5), (0.6), (2.0)) t(threshold) GROUP BY ALL")
def coverage_table(spark, d):
    c = stats.coverage(predictions(spark, d), [0.4, 0.5, 0.6, 2.0])
    return c.select("method", "threshold", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


@query("SELECT doc_id, ['de', 'en', 'es', 'fr'][CAST('0x' || substr(md5(doc_id || ':7'), 1, 8) AS BIGINT) % 4 + 1] AS pred FROM documents")
def random_baseline(spark, d):
    return stats.random_baseline(documents(spark, d).select(F.col("doc_id").alias("id")), ["de", "en", "es", "fr"], 7).select(F.col("id").alias("doc_id"), "pred")


@query()
def bootstrap_ci(spark, d):
    return stats.bootstrap(predictions(spark, d), ["0", "1"])


def _language_rows(spark, d):
    return documents(spark, d).where(F.size(t.words(F.col("text"))) > 0).select(F.concat_ws("-", "lang", "source").alias("grp"), F.col("lang").alias("label"), "text")


@query()
def classifier_logreg(spark, d):
    return stats.accuracy(ml.cross_validate(_language_rows(spark, d)))


@query()
def classifier_nb(spark, d):
    return stats.accuracy(ml.cross_validate(_language_rows(spark, d), kind="nb"))


LOO = f"""d AS (SELECT doc_id AS grp, lang AS label, list_filter({TOK.format("text")}, lambda x: length(x) >= 2) AS w FROM documents WHERE regexp_matches(text, '\\S')),
  g AS (SELECT grp, label, unnest(list_concat(w, list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d),
  tf AS (SELECT grp, label, term, 1 + ln(count(*)) AS w FROM g GROUP BY ALL), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
  v AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf, count(*) AS df FROM tf, n GROUP BY term),
  y AS (SELECT grp, label, tf.term, df, w * idf AS y FROM tf JOIN v ON tf.term = v.term), x AS MATERIALIZED (SELECT grp, label, term, df, y / sqrt(sum(y * y) OVER (PARTITION BY grp)) AS x FROM y),
  s AS (SELECT term, sum(x) AS s FROM x GROUP BY term), sc AS (SELECT term, label, sum(x) AS sc FROM x GROUP BY ALL),
  k AS (SELECT DISTINCT label AS cls FROM d), tot AS (SELECT sum(x) AS t, count(DISTINCT term) AS v FROM x), tc AS (SELECT label AS cls, sum(x) AS tc FROM x GROUP BY label),
  h AS (SELECT grp, sum(x) AS h, count(*) FILTER (df = 1) AS lone FROM x GROUP BY grp),
  e AS (SELECT x.grp, x.label, cls, x.x, s - coalesce(sc, 0) - CASE WHEN cls = x.label THEN 0 ELSE x.x END + 1 AS num FROM x JOIN s ON x.term = s.term CROSS JOIN k LEFT JOIN sc ON sc.term = x.term AND sc.label = cls WHERE df > 1),
  z AS (SELECT e.grp, e.cls, sum(e.x * (ln(t - tc - CASE WHEN e.cls = e.label THEN 0 ELSE h END + v - lone) - ln(num))) AS z FROM e JOIN h ON e.grp = h.grp JOIN tc ON tc.cls = e.cls, tot GROUP BY ALL),
  p AS (SELECT d.grp, d.label, cls, row_number() OVER (PARTITION BY d.grp ORDER BY coalesce(z, 0) DESC, cls) AS r FROM d CROSS JOIN k LEFT JOIN z USING (grp, cls))"""


@query(f"WITH {LOO} SELECT grp AS doc_id, label, cls AS pred FROM p WHERE r = 1")
def nb_leave_one_out(spark, d):
    """The language of every document by complement naive Bayes of all others."""
    rows = documents(spark, d).where(r"text rlike '\\S'").select(F.col("doc_id").alias("grp"), F.col("lang").alias("label"), "text")
    return ml.leave_one_out(rows).select(F.col("grp").alias("doc_id"), "label", "pred")


STUB = "['de', 'en', 'es', 'fr'][CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % 4 + 1]"


@query(f"""WITH c AS (SELECT doc_id AS grp, lang AS label, size, seed, unnest(range(greatest(1, CAST(ceil(length(text) / CAST(size AS DOUBLE)) AS BIGINT)))) AS chunk_no FROM documents, (VALUES (400), (900)) s(size), (VALUES (0), (1), (2)) e(seed)),
  p AS (SELECT *, {STUB.format("grp || ':' || chunk_no || ':' || size || ':' || seed")} AS pred FROM c), n AS (SELECT size, seed, grp, label, pred, count(*) AS n FROM p GROUP BY ALL),
  b AS (SELECT size, seed, grp, label, pred, row_number() OVER (PARTITION BY size, seed, grp ORDER BY n DESC, pred) AS r FROM n), a AS (SELECT size, seed, avg(CAST(label = pred AS INTEGER)) AS acc FROM b WHERE r = 1 GROUP BY ALL)
  SELECT size, count(*) AS runs, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd, round(min(acc), 6) AS low, round(max(acc), 6) AS high FROM a GROUP BY size""")
def chunk_size_spread(spark, d):
    """Document accuracy by chunk size over three seeds, of a stand-in that draws each chunk's class by hash."""
    seeds = [0, 1, 2]

    def drawn(rows, fits):
        fold = F.array(*(F.expr(f.test).cast("int") for f in fits))
        held = rows.withColumn("fit", F.explode(F.filter(F.transform(fold, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())))
        seed = F.array(*(F.lit(int(f.test.split("_f")[1].split(" ")[0])) for f in fits))[F.col("fit")]
        key = F.concat_ws(":", "grp", "chunk_no", "size", seed.cast("string"))
        return stats.random_baseline(held.withColumn("key", key), ["de", "en", "es", "fr"], None, "key")

    def pieces(text, size):
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1)) - 1)
        return F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))

    docs = documents(spark, d).select(F.col("doc_id").alias("grp"), F.col("lang").alias("label"), "text")
    got = ml.spread(ml.sweep(docs, [400, 900], seeds, pieces, 3, model=drawn), ["size"])
    return got.select("size", "runs", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high")))


# --- quiz, library, models, whole runs -----------------------------------------------------------------------------


@query(f"WITH {TOP_WORDS} SELECT domain, term, CAST(r AS INTEGER) AS rank, other FROM (SELECT a.domain, a.keyword AS term, b.keyword AS other, row_number() OVER (PARTITION BY a.domain, a.keyword ORDER BY abs(length(a.keyword) - length(b.keyword)), b.keyword) AS r FROM lex a JOIN lex b ON a.domain = b.domain AND a.keyword <> b.keyword) WHERE r <= 8")
def quiz_distractors_top8(spark, d):
    lex = made_lexicon(spark, d).groupBy(F.col("domain").alias("doc_id")).agg(F.collect_list("keyword").alias("terms"))
    return quiz.distractors(lex).withColumnRenamed("doc_id", "domain")


@query()
def quiz_items(spark, d):
    docs = documents(spark, d).select("doc_id", "text", F.array(*map(F.lit, top_words(spark, d))).alias("terms"), arrow.abbreviations(F.col("text")).alias("abbreviations"))
    return quiz.generate_local(docs)


ANSWERS = "a AS (SELECT source AS lesson_id, doc_id % 30 AS attempt, doc_id AS item_no, doc_id % 4 AS answer, CASE WHEN doc_id % 5 > 0 THEN n_chars % 4 END AS given FROM documents), g AS (SELECT lesson_id, attempt, count(*) FILTER (given = answer) AS score, count(*) AS total, coalesce(string_agg(CAST(item_no AS VARCHAR), ',' ORDER BY item_no) FILTER (given IS NULL OR given <> answer), '') AS wrong FROM a GROUP BY ALL)"


def _grades(spark, d):
    given = F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") % 4).alias("given")
    return quiz.grade(documents(spark, d).select(F.col("source").alias("lesson_id"), (F.col("doc_id") % 30).alias("attempt"), F.col("doc_id").alias("item_no"), (F.col("doc_id") % 4).alias("answer"), given))


@query(f"WITH {ANSWERS} SELECT lesson_id, attempt, score, total, wrong FROM g")
def quiz_grades(spark, d):
    return _grades(spark, d).withColumn("wrong", F.array_join("wrong", ","))


@query(f"WITH {ANSWERS}, r AS (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY attempt DESC) AS r, score / CAST(total AS DOUBLE) AS share FROM g) SELECT lesson_id, count(*) AS n, round(max(share), 6) AS best, round(arg_max(share, attempt), 6) AS last, max(share) >= 0.7 AS passed FROM r WHERE r <= 20 GROUP BY lesson_id")
def quiz_history(spark, d):
    kept = quiz.latest_attempts(_grades(spark, d).withColumn("time", F.col("attempt")))
    return quiz.attempt_stats(kept).withColumns({c: F.round(c, 6) for c in ("best", "last")})


@query("""WITH l AS (SELECT source AS lesson_id, doc_id AS time, doc_id % 2 AS seq, CASE WHEN doc_id % 37 = 0 AND source <> 'src3' THEN 'save' ELSE 'attempt' END AS op, n_chars AS score FROM documents),
  s AS (SELECT lesson_id, max(time) AS saved FROM l WHERE op = 'save' GROUP BY lesson_id), r AS (SELECT l.*, row_number() OVER (PARTITION BY l.lesson_id ORDER BY time DESC) AS r FROM l JOIN s ON l.lesson_id = s.lesson_id WHERE op = 'attempt' AND time > saved)
  SELECT lesson_id, time, score FROM r WHERE r <= 20""")
def quiz_since_save(spark, d):
    op = F.when((F.col("doc_id") % 37 == 0) & (F.col("source") != "src3"), "save").otherwise("attempt")
    log = documents(spark, d).select(F.col("source").alias("lesson_id"), F.col("doc_id").alias("time"), (F.col("doc_id") % 2).alias("seq"), op.alias("op"), F.col("n_chars").alias("score"))
    return quiz.since_save(log).select("lesson_id", "time", "score")


def _lesson_log(spark, d):
    null = {c: F.lit(None).cast(x).alias(c) for c, x in store.FIELDS.items()}

    def rows(where: str, version: int, op: str, **values):
        cols = [values[c].cast(x).alias(c) if c in values else null[c] for c, x in store.FIELDS.items()]
        return documents(spark, d).where(where).select(F.col("doc_id").cast("string").alias("id"), F.lit(version).cast("long").alias("version"), F.lit(op).alias("op"), *cols, F.col("source").alias("owner_id"))

    first = rows("true", 1, "save", title=F.concat(F.lit("t"), "doc_id"), created_at=F.lit("2024-01-01 00:00:00"), domain=F.col("lang"), audio=F.when(F.col("doc_id") % 5 == 0, F.encode("lang", "UTF-8")))
    return first.unionByName(rows("doc_id % 3 = 0", 2, "rename", title=F.concat(F.lit("r"), "doc_id"))).unionByName(rows("doc_id % 4 = 0", 3, "touch", last_opened_at=F.lit("2024-02-01 00:00:00"))).unionByName(rows("doc_id % 10 = 0", 4, "delete"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'r' ELSE 't' END || doc_id AS title, CAST(CASE WHEN doc_id % 4 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, source AS owner_id FROM documents WHERE doc_id % 10 <> 0")
def lesson_latest(spark, d):
    return store.latest(_lesson_log(spark, d)).select("id", "title", "version", "owner_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'r' ELSE 't' END || doc_id AS title, doc_id % 5 = 0 AS has_audio, CAST(CASE WHEN doc_id % 5 = 0 THEN octet_length(encode(lang)) ELSE 0 END AS INTEGER) AS audio_bytes FROM documents WHERE doc_id % 10 <> 0 AND source = 'src1'")
def lesson_list(spark, d):
    log = _lesson_log(spark, d).where(F.col("owner_id") == "src1")
    return store.listed(store.latest(log)).select("id", "title", "has_audio", "audio_bytes")


HEIR = "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'r' ELSE 't' END || doc_id AS title, CAST(CASE WHEN doc_id % 4 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END + CASE WHEN source = 'src1' AND doc_id % 2 = 0 THEN 7 ELSE 0 END AS BIGINT) AS version, '{HEIR}' AS owner_id
  FROM documents WHERE doc_id % 10 <> 0 AND ((source = 'src1' AND doc_id % 2 = 0) OR source = 'src2')""")
def lessons_adopted(spark, d):
    """An owner's lessons: its own (those of one source), and of the orphans (those of another) every other one."""
    owner = F.when(F.col("owner_id") == "src1", store.ORPHAN).when(F.col("owner_id") == "src2", HEIR).otherwise(F.col("owner_id"))
    log = _lesson_log(spark, d).withColumn("owner_id", owner).withColumn("heir", F.lit(None).cast("string"))
    orphans = log.where(F.col("owner_id") == store.ORPHAN).groupBy("id").agg(F.max("version").alias("version"), F.max_by("op", "version").alias("last")).where("last <> 'delete' and cast(id as long) % 2 = 0")
    claims = orphans.select("id", (F.col("version") + 7).alias("version"), F.lit("adopt").alias("op"), *(F.lit(None).cast(x).alias(c) for c, x in store.FIELDS.items()), F.lit(store.ORPHAN).alias("owner_id"), F.lit(HEIR).alias("heir"))
    return store.latest(store.owned(log.unionByName(claims), HEIR)).select("id", "title", "version", "owner_id")


class _Echo:
    """An offline model: the prompt's last 400 signs, or its whole text where it is to be copied."""

    def complete(self, model: str, prompt: str) -> str:
        body = prompt.split("\n\n", 1)[-1]
        return body if "word for word" in prompt else body[-400:]


def _echo() -> models.Caller:
    return models.Caller(_Echo(), ("offline",), delays=())


@query()
def map_reduce_offline(spark, d):
    return models.on_documents(documents(spark, d), _echo, lambda call, x: models.map_reduce(call, x))


@query()
def read_aloud_offline(spark, d):
    files = documents(spark, d).select("doc_id", F.split("text", "\n").alias("paragraphs"))
    return pipeline.read_aloud(files, made_lexicon(spark, d), _echo).select("doc_id", "n_blocks", "reading", "report")


@query()
def summary_run(spark, d):
    files = documents(spark, d).select("doc_id", F.split("text", "\n").alias("paragraphs"))
    return pipeline.summarize(files, made_lexicon(spark, d)).select("doc_id", "domain", "confidence", "baseline", "summary", F.col("validation.needs_review").alias("needs_review"))


@query()
def benchmark_run(spark, d):
    cases = documents(spark, d).select(F.col("doc_id").cast("string").alias("stem"), F.split("text", "\n").alias("paragraphs"), F.when(F.col("doc_id") % 2 == 0, t.lead(F.col("text"))).alias("reference"))
    return pipeline.benchmark(cases, made_lexicon(spark, d))[1]
