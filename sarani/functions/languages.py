"""Keyword lexicons, digits and scripts of the supported languages.

Every language is known by its code and by its English names. Unknown names keep
the text as it is, like identity digits and an empty lexicon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Language names, scripts, ten digits, the word for FROM, the marks
# of linear tables and the question and answer words.
NAMES = {
    "bn": "bn", "bengali": "bn", "bangla": "bn",
    "as": "as", "assamese": "as",
    "hi": "hi", "hindi": "hi",
    "or": "or", "oriya": "or", "odia": "or",
}
SCRIPTS = {"bn": "Bengali", "as": "Bengali", "hi": "Devanagari", "or": "Oriya"}
DIGITS = {"bn": "০১২৩৪৫৬৭৮৯", "as": "০১২৩৪৫৬৭৮৯", "hi": "०१२३४५६७८९", "or": "୦୧୨୩୪୫୬୭୮୯"}
FROM_WORDS = {"bn": "থেকে", "as": "পৰা", "hi": "से", "or": "ଠାରୁ"}
COLUMN_MARKS = {"bn": "<কলাম>", "hi": "<कलाम>"}
ROW_MARKS = {"bn": "<রো ", "hi": "<रो "}
QUESTION_WORDS = {"bn": "প্রশ্ন", "hi": "सवाल"}
ANSWER_WORDS = {"bn": "উত্তর", "hi": "उत्तर"}

# SQL keyword and its translation, in lexicon order. Hindi AS has the
# word for average, and Bengali IN and BETWEEN share a word; both are kept.
KEYWORDS = {
    "bn": {
        "SELECT": "নির্বাচন করুন", "FROM": "থেকে", "WHERE": "যেখানে", "GROUP BY": "দল করা",
        "ORDER BY": "সাজান হোক", "ASC": "ঊর্ধ্বগামী", "DESC": "অবরোহী", "avg": "গড়",
        "min": "সর্বনিম্ন", "max": "সর্বোচ্চ", "sum": "যোগফল", "count": "গণনা", "AVG": "গড়",
        "MIN": "সর্বনিম্ন", "MAX": "সর্বোচ্চ", "SUM": "যোগফল", "COUNT": "গণনা", "AS": "হিসাবে",
        "JOIN": "সংযুক্ত করা", "ON": "উপর", "IN": "মধ্যে", "NOT": "নয়", "BETWEEN": "মধ্যে",
        "AND": "এবং", "OR": "অথবা", "HAVING": "যার আছে", "UNION": "সংযোগ", "INTERSECT": "ছেদ",
        "EXCEPT": "বাদে", "LIMIT": "সীমা", "LIKE": "অনুরূপ", "DISTINCT": "অনন্য",
    },
    "as": {
        "SELECT": "নচয়ন কৰা", "FROM": "পৰা", "WHERE": "ক’ত", "GROUP BY": "টিম আপ কৰক",
        "ORDER BY": "সাজান হোক", "ASC": "আৰোহী", "DESC": "অৱতৰণ কৰা", "avg": "গড়",
        "min": "নূন্যতম", "max": "সৰ্বোচ্চ", "sum": "মুঠ", "count": "হিচাপ কৰা", "AVG": "গড়",
        "MIN": "নূন্যতম", "MAX": "সর্বোচ্চ", "SUM": "মুঠ", "COUNT": "হিচাপ কৰা", "AS": "যেনেকৈ",
        "JOIN": "যোগদান কৰক", "ON": "ওপৰত", "IN": "ভিতৰত", "NOT": "নহয়", "BETWEEN": "মাজত",
        "AND": "আৰু", "OR": "অথবা", "HAVING": "যাৰ আছে", "UNION": "সংযোগ", "INTERSECT": "ছেদ",
        "EXCEPT": "ইয়াৰ বাহিৰে", "LIMIT": "সীমাবদ্ধ", "LIKE": "ৰ সৈতে একেধৰণৰ",
        "DISTINCT": "অনন্য",
    },
    "hi": {
        "SELECT": "चुनना", "FROM": "से", "WHERE": "जहां", "GROUP BY": "दल बनाइये",
        "ORDER BY": "व्यवस्थित करना", "ASC": "आरोही", "DESC": "अवरोही", "avg": "औसत",
        "min": "न्यूनतम", "max": "अधिकतम", "sum": "जोड़", "count": "गणना", "AVG": "औसत",
        "MIN": "न्यूनतम", "MAX": "अधिकतम", "SUM": "जोड़", "COUNT": "गणना", "AS": "औसत",
        "JOIN": "संलग्न करना", "ON": "पर", "IN": "में", "NOT": "नहीं", "BETWEEN": "मध्य में",
        "AND": "और", "OR": "या", "HAVING": "जिसके पास", "UNION": "संयोजन",
        "INTERSECT": "प्रतिच्छेद", "EXCEPT": "सिवाय", "LIMIT": "सीमा", "LIKE": "अनुरूप",
        "DISTINCT": "अनन्य",
    },
    "or": {
        "SELECT": "ଚୟନ କରନ୍ତୁ", "FROM": "ଠାରୁ", "WHERE": "କେଉଁଠାରେ", "GROUP BY": "ଦଳ କରିବା",
        "ORDER BY": "ବ୍ୟବସ୍ଥିତ କରିବା", "ASC": "ଉର୍ଦ୍ଧ୍ୱଗାମୀ", "DESC": "ଅବରୋହୀ", "avg": "ହାରାହାରି",
        "min": "ସର୍ବନିମ୍ନ", "max": "ସର୍ବାଧିକ", "sum": "ଯୋଗଫଳ", "count": "ଗଣନା", "AVG": "ହାରାହାରି",
        "MIN": "ସର୍ବନିମ୍ନ", "MAX": "ସର୍ବାଧିକ", "SUM": "ରାଶି", "COUNT": "ଗଣନା", "AS": "ହିସାବରେ",
        "JOIN": "ସଂଲଗ୍ନ କରିବା", "ON": "ଉପରେ", "IN": "ରେ", "NOT": "ନୁହେଁ", "BETWEEN": "ମଝିରେ",
        "AND": "ଏବଂ", "OR": "କିମ୍ବା", "HAVING": "ଯାହା ପାଖରେ", "UNION": "ସଂଯୋଗ",
        "INTERSECT": "ପ୍ରତିଚ୍ଛେଦ", "EXCEPT": "ଏହା ବ୍ୟତୀତ", "LIMIT": "ସୀମା", "LIKE": "ଅନୁରୂପ",
        "DISTINCT": "ଅନନ୍ୟ",
    },
}

ASCII_DIGITS = "0123456789"


def language_of(name: str) -> str | None:
    """Language code for a code or an English name; None when unknown."""
    return NAMES.get(name.lower())


def lexicon_entries(lang: str) -> list[tuple[str, str]]:
    """(keyword, translation) in the order they are tried: longest first, then as listed.

    Lower-case forms are added; where upper and lower case differ, upper case wins.
    """
    words = dict(KEYWORDS.get(language_of(lang), {}))
    words.update({k.lower(): v for k, v in KEYWORDS.get(language_of(lang), {}).items()})
    return sorted(words.items(), key=lambda kv: -len(kv[0]))


def keyword_lexicon(spark: SparkSession, lang: str) -> DataFrame:
    """The keyword lexicon of one language as a DataFrame with its trial order."""
    rows = [(language_of(lang), s, t, i) for i, (s, t) in enumerate(lexicon_entries(lang))]
    return spark.createDataFrame(rows, "lang string, source string, target string, rank int")


def digits_of(lang: str) -> str:
    """The ten digits of a language; ASCII digits when it is unknown."""
    return DIGITS.get(language_of(lang), ASCII_DIGITS)


def translate_digits(c: Column, lang: str) -> Column:
    """0-9 to the digits of the language; all other characters stay."""
    return F.translate(c, ASCII_DIGITS, digits_of(lang))


def ascii_digits(c: Column) -> Column:
    """Digits of any supported script back to 0-9."""
    scripts = list(dict.fromkeys(DIGITS.values()))
    return F.translate(c, "".join(scripts), ASCII_DIGITS * len(scripts))


def number_of(c: Column) -> Column:
    """Text to double, Indic digits included; null when it is not a number."""
    return ascii_digits(c).try_cast("double")


def in_script(c: Column, lang: str) -> Column:
    """True when the text has a character of the language's script and no other letter.

    Unknown languages have no script: false.
    """
    script = SCRIPTS.get(language_of(lang))
    if script is None:
        return F.lit(False)
    # Two linear scans; one pattern over both classes would backtrack on digits.
    return c.rlike(rf"\p{{Is{script}}}") & ~c.rlike(rf"[\p{{L}}&&[^\p{{Is{script}}}]]")
