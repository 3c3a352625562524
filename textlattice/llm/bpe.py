"""BPE encoding and decoding by a dynamic program over prefixes.

For every prefix of a pre-token exactly one token can end its encoding.  An automaton over the
vocabulary reports all tokens that are suffixes of the prefix; the one that fits is whole by
itself or *compatible* with the last token of the prefix before it: no merge crosses their
border.  Back-pointers from the end give the ids, in time linear in the text for a fixed
vocabulary, with no merge queue.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import FLUSH_BYTES

INF = 1 << 60
#: A chunk of printable ASCII and Latin-1 letters needs no normalisation but lower case; its pre-tokens are those of the file's pattern.
PLAIN = re.compile(r"[\t-\r !-~À-ÖØ-öø-ÿ]*")
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Controls that Python counts as white space and the tokenizer does not.
ODD, BLANKS = re.compile("[\x1c-\x1f]"), re.compile("[ \t-\r]+")
#: Bounds of a worker's memory: entries of its caches, and the longest text piece that is kept.
CACHE, PAIRS, PIECE = 300_000, 1_000_000, 48


class PrefixBpe:
    """Encoder and decoder for a tokenizer file with a merge list, byte-level symbols and an end-of-word mark."""

    def __init__(self, spec: str):
        full = json.loads(spec)
        model = full["model"]
        self.vocab, mark = model["vocab"], model.get("end_of_word_suffix") or ""
        self.mark = mark
        self.text_of = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in full["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in full["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        front = Tokenizer.from_str(spec)
        self.normal, self.pieces = front.normalizer, front.pre_tokenizer
        self.spines: tuple[dict, dict] = {}, {}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        merged = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if (x, y) not in self.rank:
                self.rank[x, y] = r
                if z not in self.parts:
                    self.parts[z] = (x, y, r)
                    merged.append(z)
        spelled: dict[int, str] = {}
        for t, i in self.vocab.items():
            if i not in self.parts:
                spelled[i] = chr(0x10000 + i)
        for z in merged:
            x, y, _ = self.parts[z]
            if x in spelled and y in spelled:
                spelled[z] = spelled[x] + spelled[y]
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, s in spelled.items():
            if self._whole(i):
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        symbol = lambda c: chr(0x10000 + self.vocab[c])
        #: Plain characters and the file's byte symbols, to symbols of the automaton; of the last one, with the end-of-word mark.
        self.inner, self.final = {}, {}
        for i in (*range(33, 127), *range(0xC0, 0x100)):
            said = "".join([p for p, _ in self.pieces.pre_tokenize_str(chr(i))])
            self.inner[i] = "".join(map(symbol, said))
            self.final[chr(i)] = self.inner[i][:-1] + symbol(said[-1] + mark)
        #: Chunks of white-space parted text, and plain pieces, to their ids and decoded text; the older half of each.
        self.chunks, self.old_chunks, self.pieces_known, self.old_pieces = {}, {}, {}, {}

    def _whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as this token: its two parts merge, and nothing else comes first."""
        seen = getattr(self, "_seen", None)
        if seen is None:
            seen = self._seen = {}
        if token in seen:
            return seen[token]
        part = self.parts.get(token)
        ok = part is None or self._whole(part[0]) and self._whole(part[1]) and self.compatible(part[0], part[1], part[2])
        seen[token] = ok
        return ok

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces of a token along its border, from symbol to token, each with the rank of the merge that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            part = self.parts.get(token)
            known = [(token, INF)] if part is None else [*self._spine(part[side], side)[:-1], (part[side], part[2]), (token, INF)]
            self.spines[side][token] = known
        return known

    def compatible(self, left: int, right: int, final: int = -1) -> bool:
        """No merge crosses the border of the two tokens (but the one of rank ``final``, once both are complete)."""
        key = (left, right)
        if final < 0 and (known := self.fits.get(key)) is not None:
            return known
        ours, theirs, i, j, rank, ok = self._spine(left, 1), self._spine(right, 0), 0, 0, self.rank, True
        while True:
            (u, u_ends), (v, v_ends) = ours[i], theirs[j]
            r = rank.get((u, v), INF)
            if r < u_ends and r <= v_ends and r < INF and not (r == final and u_ends == v_ends == INF):
                ok = False
                break
            if u_ends == v_ends == INF:
                break
            if u_ends <= v_ends:
                i += 1
            else:
                j += 1
        if final < 0:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[key] = ok
        return ok

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one pre-token, given as a string of the automaton's symbols."""
        n = len(symbols)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        fits, compatible = self.fits, self.compatible
        for end, (token, size) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                ok = fits.get((before, token))
                if not (compatible(before, token) if ok is None else ok):
                    continue
            last[end], back[end] = token, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _said(self, ids: list[int]) -> tuple[array, str]:
        return array("i", ids), " ".join([self.text_of[i] for i in ids])

    def _plain(self, text: str, hits: list[tuple[array, str]]) -> None:
        """Adds the ids and decoded text of each piece of a plain text."""
        known, older = self.pieces_known, self.old_pieces
        for piece in PLAIN_PIECES.findall(text.lower()):
            hit = known.get(piece)
            if hit is None:
                hit = older.get(piece) or self._said(self.encode_symbols(piece[:-1].translate(self.inner) + self.final[piece[-1]]))
                if len(piece) <= PIECE:
                    if len(known) >= CACHE:  # what was used since the last time stays
                        self.pieces_known, self.old_pieces = known, older = {}, known
                    known[piece] = hit
            hits.append(hit)

    def _fresh(self, chunk: str) -> tuple[array, str]:
        ids: list[int] = []
        at = 0
        spans = [(m.start(), m.end()) for m in self.special.finditer(chunk)] if self.special else []
        for a, b in [*spans, (len(chunk), len(chunk))]:
            if a > at:
                for piece, _ in self.pieces.pre_tokenize_str(self.normal.normalize_str(chunk[at:a])):
                    symbols = [self.vocab[c] for c in piece[:-1]] + [self.vocab[piece[-1] + self.mark]]
                    ids += self.encode_symbols("".join([chr(0x10000 + x) for x in symbols]))
            if b > a:
                ids.append(self.added[chunk[a:b]])
            at = b
        return self._said(ids)

    def encode(self, text: str) -> tuple[array, str]:
        """Ids and their decoded text.

        No pre-token crosses white space, so white-space chunks are kept by text; a text of plain
        characters without added tokens goes by its pre-tokens at once.
        """
        hits: list[tuple[array, str]] = []
        if PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            self._plain(text, hits)
        else:
            known, older = self.chunks, self.old_chunks
            for chunk in text.split() if not ODD.search(text) else filter(None, BLANKS.split(text)):
                hit = known.get(chunk)
                if hit is None:
                    hit = older.get(chunk) or self._fresh(chunk)
                    if len(chunk) <= PIECE:
                        if len(known) >= CACHE:
                            self.chunks, self.old_chunks = known, older = {}, known
                        known[chunk] = hit
                if hit[0]:
                    hits.append(hit)
        return array("i", chain.from_iterable([h[0] for h in hits])), " ".join([h[1] for h in hits])

    def decode(self, ids) -> str:
        """The tokens joined by a space: what a tokenizer file without a decoder gives."""
        return " ".join([self.text_of[i] for i in ids])


_BUILT: dict[str, PrefixBpe] = {}


def built(spec: str) -> PrefixBpe:
    """One encoder per worker process and tokenizer."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = PrefixBpe(spec)
    return _BUILT[key]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array<int>) and ``decoded`` (string) of every whole text; no shuffle.

    The tokenizer file (its size is fixed) is read on the driver and broadcast.  A null or empty
    text has no ids and decodes to the empty string; a null id stays null; repeated rows are
    encoded each; other columns are not read, whatever their names; an empty table gives none.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built(spec.value)
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                start, flat, ends, said, size = at, array("i"), array("i", [0]), [], 0
                while at < batch.num_rows and size < FLUSH_BYTES:
                    text = texts[at].as_py() or ""
                    ids, words = bpe.encode(text)
                    flat.extend(ids)
                    ends.append(len(flat))
                    said.append(words)
                    size += len(text)
                    at += 1
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(start, at - start), lists, pa.array(said, pa.string())], names=["key", "ids", "decoded"])
        # Workers are used again by later stages, which need the memory.
        bpe.chunks, bpe.old_chunks, bpe.pieces_known, bpe.old_pieces = {}, {}, {}, {}

    out = narrow.mapInArrow(run, f"key {kind.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", id_col)
