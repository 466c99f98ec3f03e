"""Byte-level BPE ids of whole texts by the tokenizers library, with its work remembered word by word.

A byte-level BPE text falls into pre-tokens, each encoded by itself. A worker remembers the ids of words (what lies
between single spaces or line feeds); only the pre-tokens of new ones go to the library. A text in which white space
or a special token could join words differently goes to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode
from functools import lru_cache

import regex

#: Fixed value: how a byte-level tokenizer with use_regex cuts a text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters that stand for bytes in a byte-level vocabulary; printable ones for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_CHARACTERS = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))
#: White space but for the space and the line feed, and white space that touches other white space or the end.
OTHER_SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
TOUCHING = re.compile(r"\s\s|\s\Z")
#: Words that a worker remembers; beyond that, those that its last texts don't hold go.
MEMORY = 1_200_000


class ByteCodec:
    """Encoder for one tokenizer file. special: whether special tokens in texts get their own ids (the library's way
    unless told otherwise) or are ordinary text. Ids come packed as unsigned 16-bit integers if all fit, else 32-bit."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        with open(path) as f:
            told = json.load(f)
        pre = told["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or told["normalizer"] or told["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE tokenizer without prefix space and normaliser is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.special = [t["content"] for t in told["added_tokens"]] if special else []
        self.cut = regex.compile(PRE_TOKENS)
        self.model = self.library.model
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.line = self._piece("\n")

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token: the library's model takes its bytes as characters."""
        return array(self.kind, [t.id for t in self.model.tokenize(charmap_decode(piece.encode(), "strict", BYTE_CHARACTERS)[0])]).tobytes()

    def _plain(self, text: str) -> bool:
        """Whether no white space stands beside other white space or at the end, and no special token occurs."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in " \n":
            return False
        if any(map(text.__contains__, OTHER_SPACES)) and TOUCHING.search(text):
            return False
        return not any(map(text.__contains__, self.special))

    def _learn(self, keys: set[str]) -> None:
        """Ids of words. A key that begins with a line feed is that and a word without a space before it; any other
        is a word after a space. Letters with full stops and commas after them are two pre-tokens."""
        known, piece = self.known, self._piece
        known.update((x, piece(" " + x)) for x in keys if x.isalpha())
        for key in keys:
            if key in known:
                continue
            feed = key[:1] == "\n"
            body = key[1:] if feed else key
            stem = body.rstrip(".,")
            tail = body[len(stem) :]
            if stem.isalpha():
                of_stem = known.get(key[: len(key) - len(tail)]) if tail else None
                if of_stem is None:
                    of_stem = self.line + piece(stem) if feed else piece(" " + stem)
                if tail not in self.tails:
                    self.tails[tail] = piece(tail)
                known[key] = of_stem + self.tails[tail]
            else:
                found = self.cut.findall(body if feed else " " + body)
                known[key] = (self.line if feed else b"") + b"".join(map(piece, found))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        known = self.known
        get, skip, missing = known.get, len(self.line), set()
        cut: list[list[str]] = []
        ids: list[list[bytes | None] | None] = []
        for x in texts:
            if not x or not self._plain(x):
                cut.append([])
                ids.append(None)
                continue
            words = ("\n" + x).replace("\n", " \n").split(" ")[1:] if x[0] != "\n" else x.replace("\n", " \n").split(" ")[1:]
            found = list(map(get, words))
            if None in found:
                missing.update(w for w, f in zip(words, found, strict=True) if f is None)
            cut.append(words)
            ids.append(found)
        self._learn(missing)
        out = []
        for x, words, found in zip(texts, cut, ids, strict=True):
            if found is None:
                told = self.library.encode(x, add_special_tokens=False).ids if x else []
                out.append(array(self.kind, told).tobytes())
                continue
            i = -1
            for _ in range(found.count(None)):
                i = found.index(None, i + 1)
                found[i] = known[words[i]]
            packed = b"".join(found)
            out.append(packed if x[0] == "\n" else packed[skip:])  # no line feed stands before the first word
        if len(known) > MEMORY:
            self.known = {w: known[w] for w in set().union(*cut)}
        return out


@lru_cache(maxsize=2)
def codec(path: str, special: bool) -> ByteCodec:
    """One for each worker process, which keeps it over its tasks."""
    return ByteCodec(path, special)
