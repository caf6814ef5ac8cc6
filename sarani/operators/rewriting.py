"""SQL and answers rewritten into an Indic language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sarani.functions.languages import (
    FROM_WORDS, in_script, language_of, lexicon_entries, number_of, translate_digits,
)
from sarani.functions.once import let
from sarani.functions.splitjson import from_split_json
from sarani.functions.text import split_words
from sarani.operators.lookup import fits_record, record_lookup
from sarani.operators.numbering import number_within
from sarani.session import BROADCAST_ROWS

# What a number token looks like (two digits at least, signs between, before
# and after them), and a table name with its counter. No part gives characters back, so
# a long run of digits costs no more than its length.
NUMBER_TOKEN = (
    r"""(?U)\A[(-.:"'`]*+(?:\d{2,}+(?:[-:,.]++\d++)?+|\d[-:,.]++\d++)[)-:%.]*+[?'"`]*+\z"""
)
TABLE_TOKEN = r"""\A.*_[0-9]*["'`]*\z"""


def translate_keywords(c: Column, lang: str, word_bounded: bool = False) -> Column:
    """SQL keywords replaced by their translation, longest first, case as listed.

    The plain form replaces every occurrence, inside names too. `word_bounded` replaces
    whole words only and leaves quoted names and literals as they are.
    """
    entries = lexicon_entries(lang)
    if not word_bounded:
        # No translation has an ASCII letter, so only words of the given text can occur later; a test for
        # a word costs less than its search, and an empty word replaces nothing.
        given = c
        for word, target in entries:
            c = F.replace(c, F.when(F.contains(given, F.lit(word)), F.lit(word)).otherwise(F.lit("")), F.lit(target))
        return c

    # Quoted parts, keywords of two words, words, and what is between them.
    long = "|".join(word for word, _ in entries if " " in word)
    pieces = rf"`[^`]*`|\"(?:[^\"]|\"\")*\"|\b(?:{long})\b|\w+|[^\w`\"]+|[`\"]"
    table = F.create_map(*[F.lit(x) for entry in entries for x in entry])
    parts = F.regexp_extract_all(c, F.lit(pieces), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def _starts_with_letter(w: Column) -> Column:
    """An ASCII letter in front: a cheap test that spares most words the pattern."""
    first = F.substring(w, 1, 1)
    return first.between("a", "z") | first.between("A", "Z")


def translate_digit_tokens(c: Column, lang: str) -> Column:
    """Digits of number tokens translated; tokens are rejoined by one blank."""
    return F.array_join(
        F.transform(
            split_words(c),
            lambda w: F.when(
                ~_starts_with_letter(w) & w.rlike(NUMBER_TOKEN), translate_digits(w, lang)
            ).otherwise(w),
        ),
        " ",
    )


def drop_table_clause(c: Column, lang: str, table: Column) -> Column:
    """The text without its FROM word and table name."""
    code = language_of(lang)
    if code is None:
        return c
    clause = F.concat(F.lit(FROM_WORDS[code] + " `"), table, F.lit("`"))
    return F.replace(c, clause, F.lit(""))


def clean_table_token(word: Column) -> Column:
    """`x_y_12` becomes `x y`; other words stay."""
    cut = F.replace(F.regexp_replace(word, r"_[^_]*\z", ""), F.lit("_"), F.lit(" "))
    return F.when(word.rlike(TABLE_TOKEN), cut).otherwise(word)


def _core(word: Column) -> Column:
    """The word without the signs around it."""
    return F.regexp_replace(word, r"\A[^\p{L}\p{N}]+|[^\p{L}\p{M}\p{N}]+\z", "")


def _around(word: Column, core: Column, target: Column) -> Column:
    """`target` with the signs that stood around the word."""
    at = F.instr(word, core)
    return F.concat(F.substring(word, F.lit(1), at - 1), target, F.substring(word, at + F.length(core), F.length(word)))


def translate_words(
    df: DataFrame, lexicon: DataFrame, lang: str, columns: dict[str, Column], key: str, most_broadcast: int = BROADCAST_ROWS
) -> DataFrame:
    """New text columns from word lists, by a lexicon of any size (source, target).

    Words not in the script are looked up without the signs around them and kept when
    there is no entry. A record whose words are null has a null text.

    A lexicon of some thousand words is searched inside each record, and nothing is shuffled. Of a
    larger one the words that occur are looked up by `record_lookup`, which needs a unique `key`; a `key`
    of two records then ends the job. No lexicon of more than `most_broadcast` words goes to every task.
    """
    lexicon = lexicon.groupBy("source").agg(F.min("target").alias("target"))
    given = df.columns
    if not fits_record(lexicon, most_broadcast) and not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    listed = F.concat(*[F.coalesce(words, F.array().cast("array<string>")) for words in columns.values()])
    df, find = record_lookup(df, F.transform(F.array_distinct(listed), _core), lexicon, key, most_broadcast)

    def one(w):
        new = lambda core: F.transform(find(core), lambda found: F.when(~in_script(w, lang), _around(w, core, found)).otherwise(w))
        return F.coalesce(let(_core(w), lambda core: F.get(new(core), F.lit(0))), w)

    texts = [F.array_join(F.transform(words, one), " ").alias(name) for name, words in columns.items()]
    return df.select(*[c for c in given if c not in columns], *texts)


def translate_columns(header: Column, lang: str) -> Column:
    """Keywords in the column names of an answer."""
    return F.transform(header, lambda h: translate_keywords(h, lang))


def translate_answer(answer: Column, lang: str) -> Column:
    """Split-JSON answer with translated column names and digits.

    Digits change in columns of numbers and in texts that start with a digit. An
    answer without rows gives null.
    """
    def numeric(table):
        return F.transform(
            table["columns"],
            lambda _, j: F.forall(table["data"], lambda r: number_of(F.get(r, j)).isNotNull()),
        )

    def out(table, numeric):
        def cell(v, j):
            return F.when(F.get(numeric, j) | v.rlike(r"(?U)\A\d"), translate_digits(v, lang)).otherwise(v)

        return F.struct(
            translate_columns(table["columns"], lang).alias("columns"),
            table["index"].alias("index"),
            F.transform(table["data"], lambda r: F.transform(r, cell)).alias("data"),
        )

    whole = let(
        from_split_json(answer),
        lambda t: F.when(F.size(t["data"]) > 0, let(numeric(t), lambda n: out(t, n))),
    )
    return F.to_json(whole)


def _prepared(df: DataFrame, lang: str) -> DataFrame:
    """Keywords and digits translated: `_text`."""
    return df.withColumn("_text", translate_digit_tokens(translate_keywords(F.col("sql"), lang), lang))


def _word_lists(lang: str) -> dict[str, Column]:
    """The words of `_text`, with clean table names and without the table clause."""
    without = drop_table_clause(F.col("_text"), lang, F.col("input_table_name"))
    return {
        "indic_sql": F.transform(split_words(F.col("_text")), clean_table_token),
        "sql_without_table_name": split_words(without),
    }


def convert_records(df: DataFrame, lang: str, lexicon: DataFrame, key: str) -> DataFrame:
    """Samples with language, indic_sql, sql_without_table_name and translated_answer, by a
    word lexicon of any size; `key` is unique."""
    out = translate_words(_prepared(df, lang), lexicon, lang, _word_lists(lang), key)
    return (
        out.withColumn("language", F.lit(language_of(lang)))
        .withColumn("translated_answer", translate_answer(F.col("answer"), lang))
        .drop("_text")
    )


def convert_samples(df: DataFrame, lang: str, lexicon: DataFrame, order: str, first: int = 0) -> DataFrame:
    """`convert_records` with an index.

    `order` is a unique number; `index` counts the samples in that order from `first`. The samples meet
    their numbers before they are converted, by a merge join: it spreads them, and a converted
    side that looks small is not broadcast.
    """
    index = number_within(df.select(order), [], order, "index").withColumn("index", F.col("index") + first)
    out = convert_records(df.join(index.hint("merge"), order), lang, lexicon, order)
    return out.select(*[c for c in out.columns if c != "index"], "index")
