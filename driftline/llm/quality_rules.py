"""Quality rules: one threshold table, compiled into one projection of built-in functions.

Defined results: a null or empty text has no words, so every count is 0 and base_failed is true.
Repeated rows each get their own row; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import fresh, let, table, texts

SPACE = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: Frequent function words of the languages the corpus holds.
STOP_WORDS = (
    "the of and to a in is that for it on with as was by are this be at or "
    "le la les de des du et un une en que qui est dans pour par sur au "
    "der die das und den von zu mit sich ist ein eine auf nicht dem im "
    "el los las y del se que un una por con es su para lo al"
).split()

#: name, the ratio (of the measures below), smallest and largest value that pass.
RULES = [
    ("mean_word_chars", "word_chars / n_words", 2.0, 20.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.25),
    ("shouts_per_word", "n_shouts / n_words", None, 0.5),
    ("stop_word_share", "n_stop_words / n_words", 0.005, None),
    ("duplicate_line_share", "n_dup_lines / n_lines", None, 0.5),
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are compared as 64-bit hashes. Sorting (hash, position) puts equal windows side by side; the
    positions of those that have an equal neighbour are sorted again and each adds what the one before it
    has not covered. Texts without an equal pair, found by a set, skip the sorts.
    """

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def starts_of(rows: Column) -> Column:
        def twice(r: Column, i: Column) -> Column:
            near = [F.coalesce(F.get(rows, j)["h"] == r["h"], F.lit(False)) for j in (i - 1, i + 1)]
            return near[0] | near[1]

        return F.sort_array(F.transform(F.filter(rows, twice), lambda r: r["p"]))

    def of_hashes(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(rows, starts_of), covered))

    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, of_hashes))


def measures(text: Column) -> Column:
    """A struct of all counts the rules use."""
    stop = [w for w in dict.fromkeys(STOP_WORDS)]

    def of_parts(parts: Column) -> Column:
        def of_words(words: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                (F.length(text) - F.size(parts) + 1).cast("long").alias("word_chars"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(*stop))).cast("long").alias("n_stop_words"),
                F.size(F.filter(words, lambda w: w.endswith("!"))).cast("long").alias("n_shouts"),
                repeat_words(words).cast("long").alias("n_repeat_words"),
            )

        return let(F.filter(parts, lambda x: x != ""), of_words)

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    return F.struct(
        let(F.split(text, SPACE), of_parts).alias("w"),
        let(lines, of_lines).alias("l"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )


def verdict(rules: list[tuple] = RULES) -> Column:
    """The table's conjunction over the measure columns; a ratio without a value passes."""
    passed = F.lit(True)
    for _, ratio, least, most in rules:
        top, bottom = (F.col(c) for c in ratio.split(" / "))
        value = F.when(bottom > 0, top / bottom)
        if least is not None:
            passed = passed & F.coalesce(value >= least, F.lit(True))
        if most is not None:
            passed = passed & F.coalesce(value <= most, F.lit(True))
    return passed


def quality_table(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of docs."""
    counted = texts(docs).select("doc_id", measures(F.col("text")).alias("m"))
    flat = counted.select("doc_id", "m.w.*", "m.l.*", "m.n_symbols")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs; no shuffle."""
    name = fresh(docs, "measures")
    held = docs.withColumn(name, measures(F.coalesce(F.col("text"), F.lit(""))))
    flat = held.select(*docs.columns, F.struct(F.col(f"{name}.w.*"), F.col(f"{name}.l.*"), F.col(f"{name}.n_symbols")).alias(name))
    nested = [(n, " / ".join(f"{name}.{c}" for c in ratio.split(" / ")), a, b) for n, ratio, a, b in rules]
    base = (F.col(f"{name}.n_words") >= MIN_WORDS) & (100 * F.col(f"{name}.n_repeat_words") <= MAX_REPEAT_PERCENT * F.col(f"{name}.n_words"))
    return flat.filter(base & verdict(nested)).select(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_table(table(spark, sf_dir, "documents")).select(*columns)


def rules_sql(rules: list[tuple] = RULES) -> str:
    parts = []
    for _, ratio, least, most in rules:
        top, bottom = ratio.split(" / ")
        value = f"{top}::double / nullif({bottom}, 0)"
        parts += [f"coalesce({value} >= {least}, true)"] * (least is not None) + [f"coalesce({value} <= {most}, true)"] * (most is not None)
    return " and ".join(parts)


MEASURES_SQL = f"""
rows_ as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
split_ as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from rows_),
win as (select r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) g from (select r, w, unnest(range(1, len(w) - 1)) i from split_)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) n from win) where n > 1),
cover as (select r, count(distinct p) n from (select r, unnest([i, i + 1, i + 2]) p from twice) group by r),
m as (select s.r, doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
    len(l) n_lines, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words,
    len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) n_stop_words,
    len(list_filter(w, lambda x: x like '%!')) n_shouts
    from split_ s left join cover using (r)),
judged as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed, {rules_sql()} ok from m)
"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE = {
    "op9_quality_rules": f"""with {MEASURES_SQL}
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
    n_repeat_words::bigint n_repeat_words, base_failed, not base_failed and ok kept from judged"""
}
