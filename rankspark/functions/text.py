"""Column expressions on text. All are JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The delimiter marks of the index tokenizer (with blank and line feed), and the ASCII letters.
INDEX_MARKS = ".:;\"'?!,~`()/#*%+-[]{}@^"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# The gap characters of the re-ranking tokenizer and the ASCII punctuation.
RERANK_MARKS = " ,.:;\"'/-%()[]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# White space of any kind, for Java regular expressions.
WS = r"[\s\x{85}\p{Z}\x1c-\x1f\x{feff}]"
# The same characters one by one.
WS_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def char_class(chars: str) -> str:
    """A Java regex class matching any of ``chars``."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def ascii_lower(c: Column) -> Column:
    """Lower A-Z only, leaving accented letters as they are."""
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column, marks: str = " \n" + INDEX_MARKS) -> Column:
    """Maximal runs of characters outside ``marks``; null text has no tokens."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), char_class(marks) + "+"), lambda t: t != "")


def index_tokens(c: Column) -> Column:
    """Tokens of the inverted index: ASCII-lowered runs between blanks, line feeds and the index marks."""
    return tokens(ascii_lower(c))


def term_tokens(c: Column) -> Column:
    """Terms: as index_tokens, with every ASCII white space character separating too."""
    return tokens(ascii_lower(c), " \t\n\x0b\f\r" + INDEX_MARKS)


def trim_ws(c: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """True for null and for text of nothing but white space."""
    return F.coalesce(trim_ws(c) == "", F.lit(True))


def name_key(c: Column) -> Column:
    """Key under which spellings that differ in case, white space, hyphens or underscores are one name."""
    return F.regexp_replace(F.lower(c), f"({WS}|[-_])+", "")


# The English stop words.
STOP_WORDS = (
    "a about above after again against ain all am an and any are aren aren't as at be because been before being below "
    "between both but by can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few "
    "for from further had hadn hadn't has hasn hasn't have haven haven't having he her here hers herself him himself his "
    "how i if in into is isn isn't it it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself "
    "needn needn't no nor not now o of off on once only or other our ours ourselves out over own re s same shan shan't she "
    "she's should should've shouldn shouldn't so some such t than that that'll the their theirs them themselves then there "
    "these they this those through to too under until up ve very was wasn wasn't we were weren weren't what when where "
    "which while who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself yourselves"
).split()


def rerank_tokens(c: Column) -> Column:
    """Tokens of the re-ranking models: runs outside their gap characters, lowered."""
    return tokens(F.lower(c), RERANK_MARKS)


def drop_stop_words(words: Column, stop: list[str] | None = None) -> Column:
    """An array of words without the stop words; compares whole words, so ``the,`` stays."""
    return F.filter(words, lambda w: ~w.isin(stop or STOP_WORDS))


def stem(words: Column, language: str = "english") -> Column:
    """An array of words, each brought to its Snowball stem. Needs the optional package snowballstemmer."""
    try:
        import snowballstemmer
    except ImportError as e:
        raise ImportError("stemming needs the package snowballstemmer") from e
    stemmer = snowballstemmer.stemmer(language)
    run = F.pandas_udf(lambda xs: xs.map(lambda a: None if a is None else stemmer.stemWords(list(a))), "array<string>")
    return run(words)


def mask_digits(c: Column) -> Column:
    """Numbers, with a decimal part or not, become <NUMBER>."""
    return F.regexp_replace(c, r"\d+(\.\d+)?", "<NUMBER>")


def mask_unprintable(c: Column) -> Column:
    """Characters that can't be printed become hyphens."""
    return F.regexp_replace(c, r"[^\p{Print}]", "-")


def preprocess(c: Column, stop_words: bool = True, punctuation: bool = True, digits: bool = False) -> Column:
    """Lower; drop stop words among the white-space tokens; delete ASCII punctuation; tokenise; join with blanks;
    mask numbers if asked to. Null becomes empty text."""
    t = F.lower(F.coalesce(c, F.lit("")))
    if stop_words:
        t = F.array_join(F.filter(drop_stop_words(F.split(trim_ws(t), f"{WS}+")), lambda w: w != ""), " ")
    if punctuation:
        t = F.array_join(tokens(F.translate(t, PUNCTUATION, ""), RERANK_MARKS), " ")
    return mask_digits(t) if digits else t
