"""Text functions as Catalyst expressions; only stemming leaves the JVM, in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.porter2 import stem

TOKEN = r"[\p{L}\p{N}_]{2,}"
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn "
    "haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn".split()
)


def tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores, in order and in their case."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def white_tokens(text: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def tokens_and_stems(words: pa.Array) -> pa.Array:
    """Every token, followed by its stem where that differs; each distinct token of a batch is stemmed once."""
    flat = words.flatten().dictionary_encode()
    stems = [stem(w) for w in flat.dictionary.to_pylist()]
    names = flat.dictionary.to_pylist()
    pieces = [[n] if n == s else [n, s] for n, s in zip(names, stems)]
    codes = flat.indices.to_pylist()
    out, at = [], 0
    for n in (None if x is None else len(x) for x in words):
        if n is None:
            out.append(None)
            continue
        out.append([p for c in codes[at : at + n] for p in pieces[c]])
        at += n
    return pa.array(out, pa.list_(pa.string()))


def analyse(text: Column, *, stems: bool = True) -> Column:
    """Tokens, with their stems if `stems`."""
    return F.arrow_udf(tokens_and_stems, "array<string>")(tokens(text)) if stems else tokens(text)


def without_stop_words(terms: Column) -> Column:
    return F.filter(terms, lambda t: ~t.isin(*STOP_WORDS))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points of a string."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.lit(2166136261).cast("long")
    return F.aggregate(points, start, lambda a, c: (a.bitwiseXOR(c) * F.lit(16777619).cast("long")) % F.lit(4294967296).cast("long"))


def fnv1a_batch(texts: pa.Array) -> pa.Array:
    """`fnv1a` of an Arrow array, one code point of all its texts at a time."""
    names = texts.to_pylist()
    size = np.array([0 if x is None else len(x) for x in names], dtype=np.int64)
    points = np.frombuffer("".join(x or "" for x in names).encode("utf-32-le"), dtype=np.uint32)
    longest = np.argsort(-size, kind="stable")
    starts, left = (np.cumsum(size) - size)[longest], size[longest]
    h = np.full(len(names), 2166136261, dtype=np.uint32)
    n = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")  # texts of more than i points
    for i, k in enumerate(n):
        h[:k] = (h[:k] ^ points[starts[:k] + i]) * np.uint32(16777619)
    out = np.empty(len(names), dtype=np.int64)
    out[longest] = h
    return pa.array(out, mask=np.array([x is None for x in names], dtype=bool))


def round2(x: Column) -> Column:
    """Two decimals by scaling and rounding half to even."""
    return F.rint(x * 100) / 100


def html_escape(text: Column) -> Column:
    """Escapes ampersand, less and greater."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def title_length(title: Column) -> Column:
    """Number of parts between single spaces."""
    return F.size(F.split(title, " ", -1))


def sentences(text: Column) -> Column:
    """Parts that end in a full stop, exclamation or question mark before white space."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def highlight_prefixes(text: Column, terms: list[str]) -> Column:
    """Marks the words that start with one of the terms, in any case."""
    any_of = "|".join(re.escape(t) for t in terms)
    return F.regexp_replace(text, r"(?i)(^|[^\p{L}\p{N}_])((" + any_of + r")[\p{L}\p{N}_]*)", "$1<strong>$2</strong>")


def page_url(title: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(title, F.lit(" "), F.lit("_")))


def ucfirst(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def lcfirst(s: Column) -> Column:
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def token_spans(text: Column, *, stems: bool = False) -> Column:
    """Array of (token, start, end) of the tokens of two or more word characters, in order; tokens are stemmed if `stems`.

    Positions are in characters, and the end isn't included.
    """

    @F.arrow_udf("array<struct<token: string, start: int, end: int>>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        out = []
        for t in texts.to_pylist():
            found = None if t is None else [(m[0], m.start(), m.end()) for m in _WORD.finditer(t)]
            out.append(None if found is None else [{"token": stem(w) if stems else w, "start": a, "end": b} for w, a, b in found])
        return pa.array(out, kind)

    return run(text)


def token_positions(spans: Column) -> Column:
    """Map from token to its (start, end) spans, in order, of what `token_spans` returns."""
    names = F.array_distinct(F.transform(spans, lambda x: x["token"]))
    of = F.transform(names, lambda n: F.transform(F.filter(spans, lambda x: x["token"] == n), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.map_from_arrays(names, of)


_WORD = re.compile(r"\b\w\w+\b")
