"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is one last token of its encoding: the vocabulary token t that ends there and
fits the last token u of the prefix before it, where t and u fit if BPE leaves them apart when it is given just the
two.  All tokens that end at each place come from one pass of a suffix-matching (Aho-Corasick) automaton of the
vocabulary; the last tokens are stored, and following them back from the end gives the exact ids.  Time is linear in a
piece's length for a vocabulary of bounded token length, so one huge word is no problem.

Defined cases: null text is empty; empty text has no ids and decodes to the empty text; special tokens' strings
in a text are special tokens; extra columns are ignored; every row gives one row.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import docs_of, schema

MOST_PIECES, MOST_PAIRS = 900_000, 600_000  # entries of a worker's caches (some 350 and 150 bytes each); a full one starts anew
#: Texts of other characters than these are normalised and split by the library's own code, since Unicode versions differ on newer characters.
_SETTLED = regex.compile(r"[\u0000-\u052f\u1e00-\u1fff\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]*+")
#: Columns that encode() can make from the ids of each text.
COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 0x100
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class _Pieces(dict):
    """Of each piece seen: its ids and their decoded text, both joined by one space."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[str, str]:
        if len(self) >= self.bpe.most_pieces:
            self.clear()
        ids = self.bpe.encode_piece(piece)
        out = " ".join(map(str, ids)), self.bpe.decode(ids)
        if len(piece) <= 64:
            self[piece] = out
        return out


class Bpe:
    """A tokenizer file of byte-level BPE with word-end suffix, lower-casing normaliser and a splitting pattern."""

    def __init__(self, file: str, most_pieces: int = MOST_PIECES):
        self.most_pieces = most_pieces
        spec = json.loads(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        byte_of = self.byte_of = {c: b for b, c in enumerate(byte_chars())}

        def symbols(token: str) -> str:
            """One character for each byte; of the last one 256 higher where it ends a word."""
            ends = bool(suffix) and token.endswith(suffix)
            own = token[: -len(suffix)] if ends else token
            raw = "".join(chr(byte_of[c]) for c in own)
            return raw[:-1] + chr(ord(raw[-1]) + 256) if ends else raw

        self.names = {i: t for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        self.text = {i: symbols(t) for t, i in vocab.items()}
        ids = {s: i for i, s in self.text.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right = symbols(a), symbols(b)
            self.rank.setdefault((ids[left], ids[right]), (r, ids[left + right]))
        self.one = ids
        self.match = ahocorasick.Automaton()
        for s, i in ids.items():
            self.match.add_word(s, (i, len(s)))
        self.match.make_automaton()
        self.ends = bool(suffix)
        own = Tokenizer.from_str(file)
        self.normalise, self.pre_split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        step = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(step).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    def merged(self, tokens: list[int], wall: int = -1) -> list[int] | None:
        """Plain BPE of a few tokens; None as soon as a merge would cross the wall (the count of symbols before it)."""
        at = [0]
        for t in tokens:
            at.append(at[-1] + len(self.text[t]))
        while True:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in self.rank), default=None)
            if best is None:
                return tokens
            i = best[1]
            if at[i + 1] == wall:
                return None
            tokens = [*tokens[:i], self.rank[tokens[i], tokens[i + 1]][1], *tokens[i + 2 :]]
            del at[i + 1]

    def whole(self, t: int) -> bool:
        """Whether BPE of the token's own text gives the token."""
        if (ok := self.alone.get(t)) is None:
            ok = self.alone[t] = self.merged([self.one[c] for c in self.text[t]]) == [t]
        return ok

    def fit(self, u: int, t: int) -> bool:
        if (ok := self.pairs.get((u, t))) is None:
            if len(self.pairs) >= self.most_pieces * MOST_PAIRS // MOST_PIECES:
                self.pairs.clear()
            a, b = self.text[u], self.text[t]
            ok = self.pairs[u, t] = self.merged([self.one[c] for c in a + b], len(a)) is not None
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        s = piece.encode().decode("latin-1")
        if self.ends:
            s = s[:-1] + chr(ord(s[-1]) + 256)
        if (t := self.one.get(s)) is not None and self.whole(t):
            return [t]
        last = [-1] * (len(s) + 1)
        done = -1
        for end, (t, n) in self.match.iter(s):
            if end == done:
                continue
            before = end + 1 - n
            u = last[before] if before else -1
            if (before == 0 or u >= 0 and self.fit(u, t)) and self.whole(t):
                last[end + 1], done = t, end
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= len(self.text[last[at]])
        return out[::-1]

    def pieces_of(self, text: str) -> list[str]:
        if not text.isascii():
            if not _SETTLED.fullmatch(text):
                return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.pre_split(self.normalise(text))]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes by character: no final sigma
        return self.split(text.lower())

    def both(self, text: str) -> tuple[str, str]:
        """A text's ids and decoded text, each joined by one space."""
        found: list[tuple[str, str]] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                found.append((str(self.specials[part]), part))
                continue
            found += map(self.pieces.__getitem__, self.pieces_of(part))
        return " ".join([x for x, _ in found]), " ".join([y for _, y in found])

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.both(text)[0].split()))

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file: the tokens, joined by one space."""
        return " ".join([self.names[i] for i in ids])


_loaded: dict[str, Bpe] = {}


def _encoder(file, want: list[str], pieces: int):
    def run(batches):
        text = file.value
        if text not in _loaded:
            _loaded.clear()
            _loaded[text] = Bpe(text)
        bpe = _loaded[text]
        bpe.most_pieces = pieces
        for b in batches:
            out = {c: [] for c in want}
            for text in b.column("text"):
                ids, decoded = bpe.both(text.as_py() or "")
                for c in want:
                    out[c].append(
                        (ids.count(" ") + 1 if ids else 0) if c == "n_tokens"
                        else list(map(int, ids.split())) if c == "ids"
                        else decoded if c == "decoded"
                        else hashlib.sha256((ids if c == "ids_sha256" else decoded).encode()).hexdigest()
                    )
            kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[c], kinds[COLUMNS[c]]) for c in want)], names=["doc_id", *want])

    return run


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), pieces: int = MOST_PIECES) -> DataFrame:
    """doc_id and the wanted columns (see COLUMNS) for every row; path: a tokenizer file of a few MB, which is broadcast.

    pieces: how many distinct pieces of text a Python worker remembers, which costs memory and changes no result.
    """
    with open(path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs_of(docs, "doc_id", "text").mapInArrow(_encoder(file, list(columns), pieces), schema(doc_id="long", **{c: COLUMNS[c] for c in columns}))
