"""Column functions on text: tokens, kinds, offsets, normal forms, keys, escapes.

All are expressions, so they run alike in batch, SQL views and streams.  Offsets count code
points.  Only canonical composition needs Python, and only for text that a regular expression
cannot prove to be composed already.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 29 code points that count as white space.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Fixed value: hyphens that join letters; dashes that always stand alone.
HYPHENS, DASHES = r"\x{2d}\x{2010}\x{2011}", "‒–—−"
LM, LMN = r"\p{L}\p{M}", r"\p{L}\p{M}\p{N}"
#: White-space run | letters and digits with letter-flanked hyphens | any one character.
TOKEN = f"[{WS}]+|[{LMN}]+(?:(?<=[{LM}])[{HYPHENS}](?=[{LM}])[{LMN}]+)*|(?s:.)"
#: The same tokens without look-around, for engines that lack it.
TOKEN_PLAIN = f"[{WS}]+|[{LMN}]*[{LM}](?:[{HYPHENS}][{LM}](?:[{LMN}]*[{LM}])?)*[{HYPHENS}][{LM}][{LMN}]*|[{LMN}]+|(?s:.)"
#: Text that no composition changes: nothing at or above the first combining mark.
COMPOSED = r"^[\x{0}-\x{2ff}]*$"


def tokens(text: Column) -> Column:
    """The lossless partition of a text as an array of surfaces."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def kind(surface: Column) -> Column:
    """Kind of a surface without readings: space, word, number, punct or symbol."""
    return (
        F.when(surface.rlike(f"^[{WS}]*$"), "space")
        .when(surface.rlike(r"\p{L}"), "word")
        .when(surface.rlike(r"^\p{N}+$"), "number")
        .when(surface.rlike(r"^\p{P}+$"), "punct")
        .otherwise("symbol")
    )


def kind_with_readings(surface: Column, uposes: Column) -> Column:
    """Readings that are all PUNCT or all NUM decide before the characters do."""
    every = lambda u: (F.size(uposes) > 0) & F.forall(uposes, lambda x: x == u)
    return F.when(surface.rlike(f"^[{WS}]*$"), "space").when(every("PUNCT"), "punct").when(every("NUM"), "number").otherwise(kind(surface))


def with_offsets(surfaces: Column) -> Column:
    """Array of (tok_idx, text, start, end) from surfaces in order; no shuffle, one pass."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<tok_idx:int,text:string,start:int,end:int>>").alias("out"))

    def step(acc, s):
        end = acc["at"] + F.length(s)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.size(acc["out"]).alias("tok_idx"), s.alias("text"), acc["at"].alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(surfaces, zero, step, lambda acc: acc["out"])


def running_sums(x: pa.ListArray) -> pa.ListArray:
    """Running sums of each list of whole numbers; null lists stay null."""
    sizes = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.append(0, np.cumsum(x.flatten().to_numpy(zero_copy_only=False), dtype=np.int64))
    edges = np.append(0, np.cumsum(sizes))
    ends = (total[1:] - np.repeat(total[edges[:-1]], sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ends), mask=x.is_null())


def _end_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in batches:
        yield running_sums(x)


def token_ends(surfaces: Column) -> Column:
    """Ends of the surfaces of a partition: running sums of their lengths, in linear time, on flat buffers without an object for each row."""
    return F.arrow_udf(_end_arrays, "array<int>")(F.transform(surfaces, F.length))


def _coded_frames(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        for at in range(0, max(len(texts), 1), 128):
            codes, own = [], []
            for x in texts[at : at + 128]:
                c, u = (None, None) if x is None else pd.factorize(x)
                codes.append(None if c is None else c.astype(np.int32))
                own.append(u)
            yield pd.DataFrame({"codes": codes, "own": own})


def coded(surfaces: Column) -> Column:
    """Struct (codes, own) of a text's surfaces: the distinct ones in order, and the place there of each."""
    return F.pandas_udf(_coded_frames, "codes array<int>, own array<string>")(surfaces)


def explode_tokens(df, id_col: str = "doc_id", text_col: str = "text"):
    """Rows (id, tok_idx, text, start, end) in linear time and without an exchange.

    Offsets are made inside the row, so repeated and null ids are documents each.
    """
    t = df.select(F.col(id_col), tokens(F.col(text_col)).alias("_text"))
    t = t.select(id_col, "_text", token_ends(F.col("_text")).alias("_end"))
    t = t.select(id_col, F.posexplode(F.arrays_zip("_text", "_end")).alias("tok_idx", "_t"))
    return t.select(id_col, "tok_idx", F.col("_t._text").alias("text"), (F.col("_t._end") - F.length("_t._text")).alias("start"), F.col("_t._end").alias("end"))


def _placed_frames(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for lengths, texts in batches:
        for at in range(0, max(len(lengths), 1), 128):  # few rows at a time: surfaces are many objects
            ends, given = [], []
            for n, text in zip(lengths[at : at + 128], texts[at : at + 128]):
                e = None if n is None else np.cumsum(n, dtype=np.int32)
                if text is None or e is None:
                    given.append(None)
                else:
                    e = np.array(_boundaries(text)[1], np.int32)[e] if len(e) else e
                    given.append([text[i:j] for i, j in zip([0, *e.tolist()], e.tolist())])
                ends.append(e)
            yield pd.DataFrame({"ends": ends, "given": given})


def placed(surfaces: Column, given: Column) -> Column:
    """Struct (ends, given) of the tokens of a composed text in the text as given.

    ``given`` is null where composing changes nothing: then there are no other surfaces.
    """
    return F.pandas_udf(_placed_frames, "ends array<int>, given array<string>")(F.transform(surfaces, F.length), given)


#: Characters with a case, from a rule; none lies beyond the second plane.
_CASED = [c for c in map(chr, range(0x80, 0x20000)) if c.casefold() != c or c.lower() != c]
#: What folds to several characters; sharp s, which whole texts have, is apart.
SEVERAL = {c: c.casefold() for c in _CASED if len(c.casefold()) > 1 and c != "ß"}
#: Lower-case characters that the fold changes once more.
SINGLE = {c.lower(): c.casefold() for c in _CASED if len(c.casefold()) == 1 and c.casefold() not in (c, c.lower())}


def _class(chars) -> str:
    """A character class of these, as ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


#: Text of which lower case is not the fold; a capital sigma is lowered by where it stands.
FOLDS_ON = _class({"Σ", *SEVERAL, *SINGLE, *(c for c in _CASED if c.lower() in SINGLE)})
MANY = _class(SEVERAL)


def casefold(x: Column) -> Column:
    """The full case fold of Unicode: lower case, then the characters that fold to others or to several.

    Most text has none of them and is lowered only.  Which letters are pairs follows the JVM's
    version of Unicode.
    """
    x = F.replace(x, F.lit("ß"), F.lit("ss"))
    pairs = F.create_map(*(F.lit(v) for pair in SEVERAL.items() for v in pair))
    spread = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.element_at(pairs, c), c)), "")
    lowered = F.lower(F.when(x.rlike(MANY), spread).otherwise(x))
    return F.when(x.rlike(FOLDS_ON), F.translate(lowered, "".join(SINGLE), "".join(SINGLE.values()))).otherwise(F.lower(x))


#: What composition may change: code points from the first combining mark on, with the one before them.
ODD = re.compile("[\\x00-\u02ff]?[\u0300-\U0010ffff]+")


def _boundaries(text: str) -> tuple[str, list[int]]:
    """NFC and, for each of its boundaries, the boundary in the original text.

    Only pieces of ODD are looked into; no code point before the first combining mark composes with
    what is before it.
    """
    normal = unicodedata.normalize("NFC", text)
    if normal == text:
        return normal, list(range(len(text) + 1))
    out, at = [0], 0
    for m in ODD.finditer(text):
        out.extend(range(at + 1, m.start() + 1))
        out.extend(m.start() + x for x in _piece_boundaries(m.group())[1:])
        at = m.end()
    out.extend(range(at + 1, len(text) + 1))
    return normal, out


def _piece_boundaries(text: str) -> list[int]:
    """Boundaries of a short piece.

    Clusters are a starter with its marks; neighbours that compose are joined.  A cluster that is
    normal already maps one to one; inside others only the outer boundaries are safe, so inner ones
    map to the cluster's start.
    """
    if unicodedata.normalize("NFC", text) == text:
        return list(range(len(text) + 1))
    cuts = [i for i, c in enumerate(text) if i == 0 or unicodedata.combining(c) == 0] + [len(text)]
    parts = [(a, b) for a, b in zip(cuts, cuts[1:])]
    joined: list[tuple[int, int]] = []
    for a, b in parts:
        if joined:
            p, q = joined[-1]
            apart = unicodedata.normalize("NFC", text[p:q]) + unicodedata.normalize("NFC", text[a:b])
            if unicodedata.normalize("NFC", text[p:b]) != apart:
                joined[-1] = (p, b)
                continue
        joined.append((a, b))
    out = [0]
    for a, b in joined:
        piece = unicodedata.normalize("NFC", text[a:b])
        inner = list(range(a + 1, b)) if piece == text[a:b] else [a] * (len(piece) - 1)
        out += inner + [b]
    return out


def _nfc_frames(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        found = [(None, None) if x is None else _boundaries(x) for x in s]
        yield pd.DataFrame({"nfc": [n for n, _ in found], "boundaries": [b for _, b in found]})


def _nfc_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc_with_boundaries(x: Column) -> Column:
    """Struct (nfc, boundaries)."""
    return F.pandas_udf(_nfc_frames, "nfc string, boundaries array<int>")(x)


def nfc(x: Column) -> Column:
    """Composed text; rows of plain Latin skip nothing but the change (the UDF sees null for them)."""
    plain = x.rlike(COMPOSED)
    return F.coalesce(F.when(plain, x), F.pandas_udf(_nfc_series, "string")(F.when(~plain, x)))


def alignment_key(x: Column) -> Column:
    """Case folded, apostrophes and dashes unified, white space dropped (input is composed)."""
    folded = F.translate(casefold(x), "‘’ʼʻ‐‑‒–—−", "''''------")
    return F.regexp_replace(folded, f"[{WS}]+", "")


def hyphen_chains(x: Column) -> Column:
    """Alphanumeric chains with inner hyphens."""
    return F.regexp_extract_all(x, F.lit(f"[{LMN}]+(?:[{HYPHENS}][{LMN}]+)+"), F.lit(0))


def escape_gap(x: Column) -> Column:
    """Backslash, underscore, space, CR and LF made visible, in this order."""
    for a, b in (("\\", "\\\\"), ("_", "\\_"), (" ", "_"), ("\r", "\\r"), ("\n", "\\n")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def line_endings(x: Column) -> Column:
    return F.regexp_replace(x, "[^\r\n]", "")


def xml_forbidden(x: Column) -> Column:
    """1-based place, in code points, of the first character that XML 1.0 forbids, 0 without."""
    sound = F.length(F.regexp_extract(x, r"^[\x{9}\x{a}\x{d}\x{20}-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]*+", 0))
    return F.when(x.isNotNull(), F.when(sound < F.length(x), sound + 1).otherwise(0))


def xml_error(x: Column, field: str) -> Column:
    """What XML 1.0 forbids in a field: its name, the first such code point and its 0-based place; null without."""
    at = xml_forbidden(x)
    point = F.lpad(F.hex(F.ascii(F.substring(x, at, F.lit(1)))), 4, "0")
    point = F.when(F.ascii(F.substring(x, at, F.lit(1))) > 0xFFFF, F.hex(F.ascii(F.substring(x, at, F.lit(1))))).otherwise(point)
    return F.when(at > 0, F.concat(F.lit(f"{field}: U+"), point, F.lit(" at "), (at - 1).cast("string"), F.lit(" cannot be in XML 1.0")))


#: Names of encodings that an XML declaration may have.
ENCODING_NAME = re.compile(r"[A-Za-z][A-Za-z0-9._-]*")


def xml_declaration(encoding: str) -> str:
    """The declaration's line; ValueError for what is no name of an encoding."""
    if not ENCODING_NAME.fullmatch(encoding):
        raise ValueError(f"not a name of an encoding: {encoding!r}")
    return f'<?xml version="1.0" encoding="{encoding}"?>'


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def quote_attribute(x: Column) -> Column:
    """In double quotes; in single ones if the value has double quotes only."""
    e = escape_xml(x)
    for a, b in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        e = F.replace(e, F.lit(a), F.lit(b))
    both = F.concat(F.lit('"'), F.replace(e, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.when(~F.contains(e, F.lit('"')), F.concat(F.lit('"'), e, F.lit('"'))).when(~F.contains(e, F.lit("'")), F.concat(F.lit("'"), e, F.lit("'"))).otherwise(both)


def split_unescaped(x: Column, mark: str) -> Column:
    """Split on a mark that no backslash precedes; escapes stay in the parts, as does a backslash at the very end."""
    m = re.escape(mark)
    last = x.rlike(r"(?s)^[^\\]*+(?:\\.[^\\]*+)*+\\$")
    body = F.when(last, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    parts = F.regexp_extract_all(F.concat(body, F.lit(mark)), F.lit(rf"(?s)([^\\{m}]*+(?:\\.[^\\{m}]*+)*+){m}"), F.lit(1))
    return F.when(last, F.transform(parts, lambda p, i: F.when(i == F.size(parts) - 1, F.concat(p, F.lit("\\"))).otherwise(p))).otherwise(parts)


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def escape_reserved(x: Column) -> Column:
    """A backslash before each reserved character of the backend stream."""
    return F.regexp_replace(x, r"([\\^$/<>{}\[\]@#*+])", r"\\$1")


#: Fixed value: characters that a backend stream's tokenizer may not see.
PROTECTED = "\\^$/<>{}[]@#*+~|=&`\0\r"
#: Private-use code points of the first plane, from which sentinels are taken.
PRIVATE = [chr(c) for c in range(0xE000, 0xF900)]


def hide(x: Column, marks: str = PROTECTED) -> Column:
    """Struct (code, text): ``marks`` replaced by sentinels, the first private-use code points that this text has not.

    ``code`` holds the sentinels in the order of ``marks``; ``reveal`` undoes it exactly, whatever the
    text holds.  Null where the text itself leaves too few private-use code points of the first plane.
    """
    if len(set(marks)) != len(marks):
        raise ValueError("marks must differ")
    k, some = len(marks), F.array(*map(F.lit, PRIVATE))
    used = F.array_distinct(F.regexp_extract_all(x, F.lit(r"[\x{e000}-\x{f8ff}]"), F.lit(0)))
    # As many candidates as are used and one for each mark: so many are free among them.
    free = F.slice(F.array_except(F.slice(some, F.lit(1), F.size(used) + k), used), 1, k)
    code = F.when(F.size(used) == 0, F.lit("".join(PRIVATE[:k]))).when(F.size(used) + k <= len(PRIVATE), F.array_join(free, ""))
    return F.when(x.isNotNull() & code.isNotNull(), F.struct(code.alias("code"), F.call_function("translate", x, F.lit(marks), code).alias("text")))


def reveal(hidden: Column, marks: str = PROTECTED) -> Column:
    """The text that ``hide`` was given."""
    rest = marks.replace("\0", "")  # translate takes NUL for nothing
    code, out = hidden["code"], hidden["text"]
    if rest != marks:
        at = marks.index("\0") + 1
        out = F.replace(out, F.substring(code, at, 1), F.lit("\0"))
        code = F.concat(F.substring(code, 1, at - 1), F.substring(code, at + 1, len(marks)))
    return F.call_function("translate", out, code, F.lit(rest))


def whole_line_prefix(df, limit: int, id_col: str = "doc_id", text_col: str = "text"):
    """Per document the lines of its longest prefix of whole lines with at most ``limit`` characters."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    from pyspark.sql import Window

    lines = df.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))).alias("line_no", "line"))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("end", F.sum(F.length("line")).over(w)).filter(F.col("end") <= limit)


def _chunk_series(most: int):
    lines = re.compile("[^\n]*\n|[^\n]+")

    def pack(text: str) -> list[dict]:
        out, at, parts, size = [], 0, [], 0
        for line in lines.findall(text):
            if parts and size + len(line) > most:
                out.append({"start": at, "text": "".join(parts)})
                at, parts, size = at + size, [], 0
            parts.append(line)
            size += len(line)
        return out + [{"start": at, "text": "".join(parts)}] if parts else out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else pack(x))

    return run


def line_chunks(x: Column, most: int) -> Column:
    """Array of (start, text): whole lines packed up to ``most`` characters; a longer line is one chunk.  One pass over a text."""
    if most < 1:
        raise ValueError("most must be positive")
    return F.pandas_udf(_chunk_series(most), "array<struct<start:int,text:string>>")(x)
