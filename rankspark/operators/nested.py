"""Deeply nested JSON articles as flat tables that keep their parent-child links.

Method: structural-variant tables. A bottom-up tree automaton reads every object: the state of a node follows from its
label (kind of scalar, array, object) and the states of its children, so that equal shapes reach equal states whatever
the values. The state decides where an object goes: whether it is accepted as a paragraph (a text that is not blank),
whether its cite_spans hold spans, and to which subtype it belongs. A subtype is a merged variant: the names and types
of the fields an object has itself, optional (null) ones left out. Every row keeps the common supertype keys
(article_id, para_no, span_no), the link to its parent, its state and its subtype; a subtype's table is read with the
typed columns its name stands for. One narrow pass parses and routes; there is no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

BODY, SPANS, TEXT = "body_text", "cite_spans", "text"
# The typed columns of paragraphs and spans; other fields are kept in ``extra``.
_OWN = {"paragraph": ("section", TEXT), "span": ("start", "end", "ref_id", TEXT)}
_SCHEMA = (
    "article_id bigint, kind string, para_no int, span_no int, parent_no int, depth int, shape string, subtype string, fields string, "
    "text string, section string, span_start bigint, span_end bigint, ref_id string, extra string"
)
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]
_SQL_TYPES = {"n": "double", "b": "boolean"}  # everything else is kept as text


# --- reading JSON of any depth ---------------------------------------------------------------------------------------

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _whole(digits: str) -> int | str:
    """A number of more digits than Python converts stays text."""
    try:
        return int(digits)
    except ValueError:
        return digits


def _parse_deep(s: str) -> object:
    """What json.loads gives, without recursion: for texts nested deeper than the interpreter's stack."""
    skip = lambda i: _SPACE.match(s, i).end()
    root: list = []
    stack: list[tuple[list | dict, str | None]] = []
    into, key, i = root, None, skip(0)

    def put(value: object) -> None:
        if isinstance(into, dict):
            into[key] = value
        else:
            into.append(value)

    def name(i: int) -> tuple[str, int]:
        if s[i : i + 1] != '"':
            raise ValueError("a name was expected")
        k, i = scanstring(s, i + 1, True)
        i = skip(i)
        if s[i : i + 1] != ":":
            raise ValueError("a colon was expected")
        return k, skip(i + 1)

    while True:
        c = s[i : i + 1]
        if c and c in "[{":
            new: list | dict = [] if c == "[" else {}
            put(new)
            stack.append((into, key))
            into, key, i = new, None, skip(i + 1)
            if s[i : i + 1] != ("]" if c == "[" else "}"):
                if c == "{":
                    key, i = name(i)
                continue
        elif c == '"':
            v, i = scanstring(s, i + 1, True)
            put(v)
        else:
            word = next((w for w in _WORDS if s.startswith(w, i)), None)
            m = None if word else _NUMBER.match(s, i)
            if word:
                put(_WORDS[word])
                i += len(word)
            elif m:
                put(float(m[0]) if m[2] or m[3] else _whole(m[0]))
                i = m.end()
            else:
                raise ValueError("a value was expected")
        while True:  # a value has ended
            i = skip(i)
            if not stack:
                if i < len(s):
                    raise ValueError("text after the value")
                return root[0]
            c = s[i : i + 1]
            if c == ("}" if isinstance(into, dict) else "]"):
                into, key = stack.pop()
                i += 1
                continue
            if c != ",":
                raise ValueError("a comma was expected")
            i = skip(i + 1)
            if isinstance(into, dict):
                key, i = name(i)
            break


def parse(s: str) -> object:
    """The value of a JSON text of any depth, with numbers of any length. Raises ValueError if it can't be read."""
    try:
        return json.loads(s)
    except RecursionError:
        return _parse_deep(s)
    except json.JSONDecodeError:
        raise
    except ValueError:  # a number too long to convert
        return _parse_deep(s)


def _written(x: object) -> str:
    """The JSON text of a value of any depth."""
    try:
        return json.dumps(x, ensure_ascii=False)
    except (RecursionError, ValueError):
        pass
    out, stack = [], [x]
    while stack:
        e = stack.pop()
        if isinstance(e, tuple):  # text to be written as it is
            out.append(e[0])
        elif isinstance(e, dict):
            parts = [p for k, v in e.items() for p in ((", ",), (json.dumps(k, ensure_ascii=False) + ": ",), v)][1:]
            stack.extend(reversed([("{",), *parts, ("}",)]))
        elif isinstance(e, list):
            parts = [p for v in e for p in ((", ",), v)][1:]
            stack.extend(reversed([("[",), *parts, ("]",)]))
        else:
            out.append(json.dumps(e, ensure_ascii=False))
    return "".join(out)


# --- the automaton ---------------------------------------------------------------------------------------------------


class State:
    """A state of the automaton. ``name`` is the same in every process; ``speaks``: a text that is not blank, or a list
    with one; ``accepts``: an object that is a paragraph; ``spans``: an object whose cite_spans may hold spans;
    ``subtype``/``fields``: the merged variant of an object and what it is made of."""

    __slots__ = ("name", "sort", "speaks", "accepts", "spans", "subtype", "fields")

    def __init__(self, sort: str, label: str, speaks: bool = False, accepts: bool = False, spans: bool = False, fields: str = ""):
        self.sort, self.speaks, self.accepts, self.spans, self.fields = sort, speaks, accepts, spans, fields
        self.name = sort + (xxhash.xxh64_hexdigest(label.encode("utf-8", "surrogatepass")) if label else "")
        self.subtype = "t" + xxhash.xxh64_hexdigest(fields.encode("utf-8", "surrogatepass"))


_NULL, _BOOL, _NUM, _BLANK, _STR = State("z", ""), State("b", ""), State("n", ""), State("w", ""), State("s", "", speaks=True)
_TYPE = {"w": "s", "a": "j", "o": "j"}  # field types of a subtype: a blank text is text, what is nested is JSON
_STATES: dict[tuple, State] = {}


def _leaf(x: object) -> State:
    if isinstance(x, str):
        return _STR if x.strip() else _BLANK
    if x is None:
        return _NULL
    return _BOOL if isinstance(x, bool) else _NUM


def transition(x: dict | list, children: list[State]) -> State:
    """State of an array or object. That of an array forgets how often and in which order its element states occur;
    that of an object is over its (key, state) pairs. Equal arguments give the same State of a process."""
    at = (*x, None, *children) if isinstance(x, dict) else (False, *{c.name: c for c in children}.values())
    known = _STATES.get(at)
    if known is not None:
        return known
    if isinstance(x, list):
        made = State("a", "a" + ",".join(sorted({c.name for c in children})), speaks=any(c.speaks for c in children))
    else:
        of = dict(zip(x, children, strict=True))
        label = "o" + ",".join(sorted(f"{k}:{c.name}" for k, c in of.items()))
        typed = json.dumps({k: _TYPE.get(c.sort, c.sort) for k, c in sorted(of.items()) if c.sort != "z" and k not in (BODY, SPANS)})
        text, cites = of.get(TEXT), of.get(SPANS)
        made = State("o", label, accepts=text is not None and text.sort in "sa" and text.speaks, spans=cites is not None and cites.sort in "aso", fields=typed)
    if len(_STATES) > 200_000:
        _STATES.clear()
    _STATES[at] = made
    return made


def shape_states(root: object) -> dict[int, State]:
    """State of every object and array under ``root``, keyed by id(). Works without recursion, so depth is not limited
    by the interpreter."""
    state: dict[int, State] = {}
    stack = [(root, False)]
    while stack:
        x, ready = stack.pop()
        if not isinstance(x, dict | list):
            continue
        children = list(x.values()) if isinstance(x, dict) else x
        if not ready:
            stack.append((x, True))
            stack.extend((c, False) for c in children if isinstance(c, dict | list))
            continue
        state[id(x)] = transition(x, [state[id(c)] if isinstance(c, dict | list) else _leaf(c) for c in children])
    return state


# --- routing ---------------------------------------------------------------------------------------------------------


def _flat(x: object, kind: type) -> list:
    """``x`` if it is of ``kind``, or what is of it in a list at any depth, in written order."""
    out, stack = [], [x]
    while stack:
        e = stack.pop()
        if isinstance(e, kind):
            out.append(e)
        elif isinstance(e, list):
            stack.extend(reversed(e))
    return out


def _unwrap(x: object) -> object:
    """A value written as a JSON string stands for what it holds."""
    while isinstance(x, str):
        try:
            y = parse(x)
        except ValueError:
            return x
        if not isinstance(y, dict | list | str) or y == x:
            return x
        x = y
    return x


def _int(x: object) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 2**63 else None


def _str(x: object) -> str | None:
    return None if x is None else x if isinstance(x, str) else _written(x)


def _clean(s: str | None) -> str | None:
    """Unpaired surrogates cannot be stored; they become question marks."""
    return None if s is None else s.encode("utf-8", "replace").decode("utf-8")


def _rest(x: dict, without: tuple[str, ...]) -> str | None:
    more = {k: v for k, v in x.items() if k not in without}
    return _clean(_written(more)) if more else None


def shred(article_id: int, payload: str | None, keys_only: bool = False) -> list[tuple]:
    """Rows of one payload: what the automaton accepts, in reading order. With ``keys_only`` the articles' own rows are
    left out, and so are the values, which then need not be built. A payload that can't be read gives one row of the
    kind 'unreadable' with the reason; a null one gives none."""
    if payload is None:
        return []
    no_values = (None,) * 6
    unreadable = lambda why: [] if keys_only else [(article_id, "unreadable", 0, 0, None, 0, None, None, None, why, *no_values[1:])]
    try:
        root = _unwrap(parse(payload))
    except ValueError as e:
        return unreadable(_clean(str(e)))
    if not isinstance(root, dict):
        return unreadable("not an object")
    rows = []
    if not keys_only:
        top, meta = shape_states(root)[id(root)], root.get("metadata")
        title = meta.get("title") if isinstance(meta, dict) else None
        rows.append((article_id, "article", 0, 0, None, 0, top.name, top.subtype, top.fields, _clean(_str(title)), _clean(_str(root.get("paper_id"))), None, None, None, _rest(root, (BODY, "paper_id")) or "{}"))
    body = _unwrap(root.get(BODY))
    state, held = shape_states(body), [body]

    def state_of(x: dict | list) -> State:
        known = state.get(id(x))
        if known is None:  # it was written as a string
            state.update(shape_states(x))
            held.append(x)
            known = state[id(x)]
        return known

    n = 0
    stack: list[tuple[object, int, int]] = [(body, 0, 1)]
    while stack:
        x, parent, depth = stack.pop()
        x = _unwrap(x)
        if isinstance(x, list):
            stack.extend((e, parent, depth) for e in reversed(x))
            continue
        if not isinstance(x, dict):
            continue
        st = state_of(x)
        if st.accepts:
            n += 1
            values = no_values if keys_only else (_clean("".join(_flat(x[TEXT], str))), _clean(_str(x.get("section"))), None, None, None, _rest(x, (BODY, SPANS, *_OWN["paragraph"])))
            rows.append((article_id, "paragraph", n, 0, parent, depth, st.name, st.subtype, st.fields, *values))
            for k, s in enumerate(_flat(_unwrap(x[SPANS]), dict) if st.spans else (), 1):
                ss = state_of(s)
                values = no_values if keys_only else (_clean(_str(s.get(TEXT))), None, _int(s.get("start")), _int(s.get("end")), _clean(_str(s.get("ref_id"))), _rest(s, _OWN["span"]))
                rows.append((article_id, "span", n, k, n, depth, ss.name, ss.subtype, ss.fields, *values))
            parent = n
        if BODY in x:
            stack.append((x[BODY], parent, depth + 1))
    return rows


def _shred_batches(keys_only: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for article_id, payload in zip(pdf["article_id"], pdf["payload"], strict=True):
                rows += shred(article_id, payload, keys_only)
                if len(rows) >= 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("para_no", "span_no", "parent_no", "depth"):
        pdf[c] = pdf[c].astype("Int32")
    for c in ("span_start", "span_end", "article_id"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def shred_articles(articles: DataFrame, keys_only: bool = False) -> DataFrame:
    """The supertype table of all objects: ``article_id, kind, para_no, span_no, parent_no, depth, shape, subtype,
    fields, text, section, span_start, span_end, ref_id, extra``. Needs columns article_id and payload; others are
    ignored. With ``keys_only`` paragraphs and spans only, without their values."""
    rows = articles.where("payload is not null and article_id is not null").select("article_id", "payload")
    return rows.mapInPandas(_shred_batches(keys_only), _SCHEMA)


def article_tables(articles: DataFrame) -> dict[str, DataFrame]:
    """The typed tables ``articles``, ``paragraphs`` and ``spans``, the ``shapes`` census, the ``subtypes`` the shapes
    are merged to, and ``unreadable`` payloads with the reason.

    A paragraph is an object with a text that is not blank, reached from the payload's body_text through body_text
    and lists only; para_no counts them per article in reading order, an object before those inside it, and
    ``parent_no`` is the paragraph it stands in (0: the article). A span is an object in a paragraph's cite_spans,
    span_no from 1 in written order; nulls do not count. Repeated article rows each give their own rows.
    """
    al = shred_articles(articles)
    of = lambda k: F.col("kind") == k
    objects, counts = al.where(~of("unreadable")), [F.count(F.lit(1)).alias("n_objects"), F.countDistinct("article_id").alias("n_articles")]
    return {
        "articles": al.where(of("article")).select("article_id", "shape", F.col("section").alias("paper_id"), F.col("text").alias("title"), F.col("extra")),
        "paragraphs": al.where(of("paragraph")).select("article_id", "para_no", F.col("parent_no").alias("parent_para_no"), "depth", "shape", "subtype", "section", "text", "extra"),
        "spans": al.where(of("span")).select("article_id", "para_no", "span_no", "shape", "subtype", F.col("span_start").alias("start"), F.col("span_end").alias("end"), "ref_id", "text", "extra"),
        "shapes": objects.groupBy("kind", "shape").agg(*counts),
        "subtypes": objects.groupBy("kind", "subtype", "fields").agg(F.countDistinct("shape").alias("n_shapes"), *counts),
        "unreadable": al.where(of("unreadable")).select("article_id", F.col("text").alias("reason")),
    }


def subtype_table(objects: DataFrame, kind: str, fields: str) -> DataFrame:
    """The table of one subtype of paragraphs or spans, out of shred_articles(): the supertype keys, the link to the
    parent, and one typed column per field of the subtype (what is nested as JSON text). ``fields`` is the JSON text
    that names the subtype in the column of that name."""
    own = {"section": "section", TEXT: "text", "start": "span_start", "end": "span_end", "ref_id": "ref_id"}
    rows = objects.where((F.col("kind") == kind) & (F.col("fields") == fields))
    more = F.from_json("extra", "map<string,string>")
    columns = [F.col(own[k]).alias(k) if k in _OWN[kind] else more[k].try_cast(_SQL_TYPES.get(t, "string")).alias(k) for k, t in json.loads(fields).items()]
    return rows.select("article_id", "para_no", "span_no", F.col("parent_no").alias("parent_para_no"), *columns)


def write_subtypes(articles: DataFrame, path: str) -> None:
    """All objects once, in one folder per kind and subtype, so that a subtype is read without the others."""
    shred_articles(articles).where("kind != 'unreadable'").write.mode("overwrite").partitionBy("kind", "subtype").parquet(path)


def read_subtype(spark: SparkSession, path: str, kind: str, fields: str) -> DataFrame:
    """A subtype's typed table out of write_subtypes(); only its folder is read."""
    subtype = State("o", "", fields=fields).subtype
    return subtype_table(spark.read.parquet(path).where((F.col("kind") == kind) & (F.col("subtype") == subtype)), kind, fields)
