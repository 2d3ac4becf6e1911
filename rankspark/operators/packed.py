"""Several values packed into one text field: one row per value, with its place.

Method: quoted spans are replaced by indexed placeholders that cannot collide with anything else in the text, the
rest is split at the delimiters, the spans are put back by looking up their index in an array, and the array is
exploded with positions. Everything is JVM-side; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rankspark.functions.text import trim_ws

# What separates values (with any control character), and what may surround a value.
DELIMITERS = ";,|"
OPEN, CLOSE = "[({<", "])}>"
MAX_STAND_INS = 10_000

_CTRL = r"\p{Cc}"
_BLANK = r"\p{Z}\x{feff}"  # white space that is no control character and so no delimiter
_OPENS, _ENDS = rf"{_BLANK}\[({{<", rf";,|{_CTRL}"
# Every repetition is of one character class or possessive, and none is begun again within its own run, so matching
# takes linear time and no stack that grows with the text.
_BEFORE = rf"(?:^|(?<![{_OPENS}{_ENDS}])[{_OPENS}]*+[{_ENDS}])[{_OPENS}{_ENDS}]*+"
_AFTER = rf"(?=[{_BLANK}\])}}>]*+(?:$|[{_ENDS}]))"
# A quote mark counts only around a whole value; inside, the mark is doubled, or the other kind of mark is used.
_QUOTED = rf"({_BEFORE})(\"[^\"]*+(?:\"\"[^\"]*+)*+\"|'[^']*+(?:''[^']*+)*+'){_AFTER}"
_HOLD = "\x01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used, also in the lambdas of ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _strip_brackets(c: Column) -> Column:
    """Drop brackets that surround a value or were cut from their partner, but none that belongs to a pair inside."""
    for _ in range(2):
        for o, x in zip(OPEN, CLOSE, strict=True):
            inner = f"[^\\{o}\\{x}]"
            c = F.regexp_replace(c, f"^\\{o}((?:{inner}++|\\{o}{inner}*+\\{x})*+)\\{x}$", "$1")
            c = F.regexp_replace(c, f"^\\{o}++({inner}*+)$|^({inner}*+)\\{x}++$", "$1$2")
        c = trim_ws(c)
    return c


def split_packed(c: Column, stand_ins: list[str] | None = None) -> Column:
    """``array<string>`` of the values packed into ``c``, in written order.

    Delimiters are semicolon, comma, bar and control characters, never a blank alone, and nothing inside quotes.
    Surrounding white space, quotes and brackets are not part of a value. Empty entries and entries equal to one of
    ``stand_ins`` (trimmed, any case) are dropped. Null gives an empty array; an unclosed quote is ordinary text.
    Fields and values of any length take time in proportion to it.
    """
    plain = lambda x: F.regexp_replace(x, _CTRL, ";")

    def split(t: Column) -> Column:
        # The context a span was matched with goes before its placeholder; control characters of the remaining text
        # become delimiters first, so that the mark of a placeholder cannot occur in it.
        parts = F.struct(
            F.regexp_extract_all(t, F.lit(_QUOTED), F.lit(2)).alias("spans"), F.regexp_extract_all(t, F.lit(_QUOTED), F.lit(1)).alias("before"), F.split(t, _QUOTED).alias("rest"),
        )
        return F.when(t.rlike(_QUOTED), _let(parts, _held)).otherwise(F.transform(F.split(plain(t), f"[{DELIMITERS}]"), _bare))

    def _held(p: Column) -> Column:
        held = F.transform(
            p["rest"],
            lambda r, i: F.concat(plain(r), F.when(i < F.size(p["spans"]), F.concat(plain(F.get(p["before"], i)), F.lit(_HOLD), i.cast("string"), F.lit(_HOLD))).otherwise(F.lit(""))),
        )
        return F.transform(F.split(F.array_join(held, ""), f"[{DELIMITERS}]"), lambda e: restore(e, p["spans"]))

    def _bare(e: Column) -> Column:
        bare = trim_ws(e)
        bare = F.when(bare.rlike(r"^[\[({<]|[\])}>]$"), _strip_brackets(bare)).otherwise(bare)
        return trim_ws(F.regexp_replace(bare, r"^[\"']++|(?<![\"'])[\"']++$", ""))

    def restore(e: Column, spans: Column) -> Column:
        def span(s: Column) -> Column:
            quote = F.substring(s, 1, 1)
            return trim_ws(F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.concat(quote, quote), quote))

        at = F.regexp_extract(e, f"{_HOLD}(\\d+){_HOLD}", 1).try_cast("int")
        return F.when(at.isNotNull(), _let(F.get(spans, at), span)).otherwise(_bare(e))

    values = F.filter(_let(F.coalesce(c, F.lit("")), split), lambda v: v != "")
    if stand_ins:
        drop = F.array(*[F.lit(s) for s in stand_ins])
        values = F.filter(values, lambda v: ~F.array_contains(drop, F.lower(v)))
    return values


def stand_in_list(stand_ins: DataFrame, column: str = "stand_in") -> list[str]:
    """The stand-in texts, trimmed and lowered. The table is a fixed word list; a larger one is refused, since its
    entries become part of the expression."""
    rows = stand_ins.select(F.lower(trim_ws(F.col(column))).alias("s")).where("s is not null").distinct().limit(MAX_STAND_INS + 1).collect()
    if len(rows) > MAX_STAND_INS:
        raise ValueError(f"more than {MAX_STAND_INS} stand-ins")
    return sorted(r.s for r in rows)


def explode_packed(df: DataFrame, id_col: str, fields: list[str], stand_ins: list[str] | None = None, value: str = "value") -> DataFrame:
    """Rows ``(id_col, field_name, pos, value)``, one per value packed into each of ``fields``; pos counts from 1
    within a field. A row or field without values gives no rows; other columns of ``df`` are ignored."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), split_packed(F.col(f), stand_ins).alias("vals")) for f in fields])).alias("f")
    long = df.select(F.col(id_col), one)
    return long.select(id_col, "f.field_name", F.posexplode("f.vals").alias("p", value)).select(
        id_col, "field_name", (F.col("p") + 1).cast("int").alias("pos"), value
    )
