"""Quality rules whose limits come from the data: mergeable sketches per language and source.

Every document gets counts from its words and lines, with built-in functions only. Documents
that pass the base rules feed quantile sketches: a histogram per (language, source, measure)
over values cut to their six leading bits, so a quantile is at most 1/32 too low. Sketches are
plain counts: they are merged by adding, and partly added before any shuffle, so a source with a
third of all rows moves no more than another. A source with fewer than ``MIN_DOCS`` documents uses
its language's merged sketch, a language with fewer the one of all documents.

Limits are fences around the quartiles: ``REACH`` times their distance, and for each measure a
slack that keeps a source without any variation from rejecting small differences. A document is kept
when it passes the base rules and each measure lies within its fences.

Nulls: a null text has no words and fails the base rules; null language and source are values of
their own; a null ``doc_id`` is kept. Repeated rows count repeatedly and get the same verdict. An
empty table gives an empty result.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparselens.llm.common import join_small, staged

WORD, SPACES, SYMBOLS, WINDOW = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r", "#*$%&|<>", 5
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_DOCS, REACH, LEADING_BITS = 10, 20, 50, 3, 6
#: Slack of each measure's fences, in its own unit.
SLACK = {"symbol_share": 100, "mark_share": 500, "word_length": 200, "dup_line_share": 3_000, "repeat_share": 1_500}


def with_counts(docs):
    """doc_id, lang, source and the counts of every document."""
    have = {c.lower() for c in docs.columns}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long"), *((F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")),
                        text.alias("_t"))
    # every column below is used more than once, so each is computed in a step of its own
    cut = named.withColumns({"_w": F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)),
                             "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)),
                             "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
                             "n_marks": (F.length("_t") - F.length(F.translate("_t", "!?", ""))).cast("long"),
                             "word_chars": F.length(F.translate("_t", SPACES, "")).cast("long")}).drop("_t")
    counted = cut.withColumns({
        "n_words": F.size("_w").cast("long"), "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    }).drop("_w", "_lines")
    # only where a window comes twice are windows sorted with their places
    sorted_ = counted.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    same = lambda x, j: (F.get("_s", j)["h"] == x["h"])
    places = sorted_.withColumn("_p", F.sort_array(F.transform(F.filter(
        "_s", lambda x, j: F.coalesce(same(x, j + 1), F.lit(False)) | F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False))), lambda x: x["i"]))).drop("_s")
    covered = F.aggregate(F.transform("_p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - x, F.lit(WINDOW)))),
                          F.lit(0), lambda a, x: a + x)
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def measures():
    """Whole-number measures of a counted document."""
    part = lambda top, bottom, unit: F.expr(f"({unit} * {top}) div greatest(1, {bottom})")
    return {"symbol_share": part("n_symbols", "word_chars", 10_000), "mark_share": part("n_marks", "n_words", 10_000),
            "word_length": part("word_chars", "n_words", 100), "dup_line_share": part("n_dup_lines", "n_lines", 10_000),
            "repeat_share": part("n_repeat_words", "n_words", 10_000)}


def sketches(counted):
    """(lang, source, measure, cell, n): the sketch of every language and source."""
    each = F.explode(F.create_map(*(x for k, m in measures().items() for x in (F.lit(k), m)))).alias("measure", "value")
    drop = f"greatest(0, length(bin(value)) - {LEADING_BITS})"
    return (counted.where(~F.col("base_failed")).select("lang", "source", each)
            .select("lang", "source", "measure", F.expr(f"shiftleft(shiftright(value, {drop}), {drop})").alias("cell"))
            .groupBy("lang", "source", "measure", "cell").agg(F.count("*").alias("n")))


def fences(sketch, keys):
    """Lower and upper limit of each measure for each value of ``keys``, and the documents behind them."""
    merged = sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("cell")), "all": F.sum("n").over(group)})
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("cell")))
    cut = ranked.groupBy(*keys, "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("all").alias("docs"))
    slack = F.expr("case measure " + " ".join(f"when '{k}' then {v}" for k, v in SLACK.items()) + " end")
    cut = cut.select(*keys, "measure", "docs", (F.col("q1") - REACH * (F.col("q3") - F.col("q1")) - slack).alias("low"),
                     (F.col("q3") + REACH * (F.col("q3") - F.col("q1")) + slack).alias("high"))
    sides = [F.max(F.when(F.col("measure") == k, F.col(s))).alias(f"{s}_{k}") for k in SLACK for s in ("low", "high")]
    return cut.groupBy(*keys).agg(F.max("docs").alias("docs"), *sides)


def limits(sketch):
    """One row for each language and source: its own fences, its language's or those of all documents."""
    sides = [f"{s}_{k}" for k in SLACK for s in ("low", "high")]
    own = fences(sketch, ["lang", "source"])
    by_lang = fences(sketch, ["lang"]).select(F.col("lang").alias("_lang"), F.col("docs").alias("_docs"), *(F.col(s).alias(f"_{s}") for s in sides))
    whole = fences(sketch.withColumn("one", F.lit(1)), ["one"]).select(F.struct(*sides)).scalar()
    met = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("_whole", whole)
    chosen = lambda s: F.when(F.col("docs") >= MIN_DOCS, F.col(s)).when(F.col("_docs") >= MIN_DOCS, F.col(f"_{s}")).otherwise(F.col(f"_whole.{s}"))
    key = F.struct("lang", "source")
    return met.select(F.xxhash64(F.to_json(key)).alias("_group"), *(chosen(s).alias(s) for s in sides))


def quality_verdicts(docs):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    counted = staged(with_counts(docs), "counts")
    sketch = staged(sketches(counted), "sketches")
    grouped = counted.withColumn("_group", F.xxhash64(F.to_json(F.struct("lang", "source"))))
    met = join_small(grouped, limits(sketch), ["_group"], "left", ["doc_id", "n_words", "word_chars"])
    within = F.lit(True)
    for k, m in measures().items():
        within = within & m.between(F.col(f"low_{k}"), F.col(f"high_{k}"))
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def measure_sql(k):
    top, bottom, unit = {"symbol_share": ("n_symbols", "word_chars", 10_000), "mark_share": ("n_marks", "n_words", 10_000),
                         "word_length": ("word_chars", "n_words", 100), "dup_line_share": ("n_dup_lines", "n_lines", 10_000),
                         "repeat_share": ("n_repeat_words", "n_words", 10_000)}[k]
    return f"({unit} * {top}) // greatest(1, {bottom})"


def fence_sql(name, keys):
    key = "".join(f"{k}, " for k in keys)
    part = f"partition by {key} measure"
    slack = "case measure " + " ".join(f"when '{k}' then {v}" for k, v in SLACK.items()) + " end"
    sides = ", ".join(f"max(case when measure = '{k}' then {s} end) as {s}_{k}" for k in SLACK for s in ("low", "high"))
    group = f"group by {', '.join(keys)}" if keys else ""
    return f"""
{name}_m as (select {key} measure, cell, count(*) as n from cells group by {key} measure, cell),
{name}_r as (select *, sum(n) over ({part} order by cell) as upto, sum(n) over ({part}) as total from {name}_m),
{name}_q as (select {key} measure, max(total) as docs, min(case when 4 * upto >= total then cell end) as q1,
  min(case when 4 * upto >= 3 * total then cell end) as q3 from {name}_r group by {key} measure),
{name}_f as (select {key} measure, docs, q1 - {REACH} * (q3 - q1) - ({slack}) as low, q3 + {REACH} * (q3 - q1) + ({slack}) as high from {name}_q),
{name} as (select {key} max(docs) as docs, {sides} from {name}_f {group})"""


def oracle():
    drop = f"greatest(0, length(bin(value)) - {LEADING_BITS})"
    cells = " union all ".join(f"select lang, source, '{k}' as measure, {measure_sql(k)} as value from c where not base_failed" for k in SLACK)
    ok = " and ".join(
        f"{measure_sql(k)} between " + " and ".join(
            f"(case when o.docs >= {MIN_DOCS} then o.{s}_{k} when l.docs >= {MIN_DOCS} then l.{s}_{k} else wa.{s}_{k} end)" for s in ("low", "high"))
        for k in SLACK)
    return rf"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select r, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') as g from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
dup as (select r, i, lead(i) over (partition by r order by i) as nx from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
rep as (select r, sum(least(5, coalesce(nx - i, 5))) as n from dup group by r),
b as (select w.r, doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::bigint as n_marks, len(ls)::bigint as n_lines,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from w left join rep on w.r = rep.r),
c as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from b),
v as ({cells}),
cells as (select lang, source, measure, (value >> ({drop})) << ({drop}) as cell from v),
{fence_sql('o', ['lang', 'source'])},
{fence_sql('l', ['lang'])},
{fence_sql('w_all', [])}
select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce({ok}, false) as kept
from c left join o on c.lang is not distinct from o.lang and c.source is not distinct from o.source
left join l on c.lang is not distinct from l.lang cross join w_all as wa"""
