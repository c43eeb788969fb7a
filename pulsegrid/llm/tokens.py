"""Token ids of whole texts, as the ``tokenizers`` library gives them.

Encoding a long text in one call costs the library about a microsecond a character, because it aligns every word again. Here the
text is split into words as the tokenizer file says, and each Python worker keeps the ids of words it has met and asks the
library's own BPE model for new ones only. The splitter and the normaliser stand in this module; files that ask for others are refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import regex

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: How the two kinds of files split texts (fixed values of the tokenizer files), and the same for texts in ASCII.
_BYTE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+")
_LOWER_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")
_BYTE_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_LOWER_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: What a file must ask for (fixed values): normaliser and splitter by kind, and the model's options.
_ASKS = {
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
    ),
}
_PLAIN = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
#: Longer words are encoded each time they occur; the others take this many bytes of a worker's memory at most, twice.
LONGEST_KEPT = 64
KEPT_BYTES = 80 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    table.update((b, chr(256 + k)) for k, b in enumerate(hidden))
    return [table[b] for b in range(256)]


ALPHABET = dict(enumerate(byte_alphabet()))


def spell(word: str) -> str:
    """A word in the byte alphabet."""
    if word.isascii():
        if word.isalnum():
            return word
        if word[:1] == " " and word[1:].isalnum():
            return ALPHABET[32] + word[1:]
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(ALPHABET)


def split_bytes(text: str) -> list[bytes]:
    """The parts that a file of kind 'byte' encodes one by one; strings of special tokens are plain text."""
    if text.isascii():
        return [part.encode() for part in _BYTE_ASCII.findall(text)]
    return [part.encode("utf-8", "surrogatepass") for part in _BYTE_WORDS.findall(text)]


def fold(text: str) -> str:
    """NFC, then each character's own lower case (no final sigma, as the library does)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def checked(path: str, kind: str) -> dict:
    """The content of a tokenizer file whose normaliser, splitter and model options are those of ``kind``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def bare(x):
        return {k: bare(v) for k, v in x.items() if k != "trim_offsets"} if isinstance(x, dict) else [*map(bare, x)] if isinstance(x, list) else x

    options = {k: spec["model"].get(k) or _PLAIN[k] for k in _PLAIN}
    plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if (bare(spec["normalizer"]), bare(spec["pre_tokenizer"])) != _ASKS[kind] or options != _PLAIN or not plain:
        raise ValueError(f"{path} is no tokenizer of kind {kind!r}")
    return spec


class Ids(dict):
    """Word -> ids as little-endian unsigned 16-bit numbers.

    Two generations of ``room`` bytes at most are kept: when the young one is full it becomes the old
    one, and words met again move back, so that common words stay and memory is bounded.
    """

    def __init__(self, encode, room: int = KEPT_BYTES):
        super().__init__()
        self.encode, self.room, self.free, self.old = encode, room, room, {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
            if len(word) > LONGEST_KEPT:
                return ids
        self.free -= 160 + len(word) + len(ids)
        if self.free < 0:
            self.old, self.free = dict(self), self.room
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """``ids(text)``: the ids of a whole text. ``kind`` is 'byte' or 'word', after the vocabulary."""

    def __init__(self, path: str, kind: str, word_ids=None):
        from tokenizers import Tokenizer

        self.spec = checked(path, kind)
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 65_536:
            raise ValueError("ids must fit 16 bits")
        self.lower, self.model = kind == "word", self.library.model
        self.ascii, self.any = (_LOWER_ASCII, _LOWER_WORDS) if self.lower else (_BYTE_ASCII, _BYTE_WORDS)
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = {s: array("H", [self.library.token_to_id(s)]).tobytes() for s in special}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.words = Ids(word_ids or self._word)

    def _word(self, word: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(spell(word))]).tobytes()

    def _plain(self, text: str) -> bytes:
        if self.lower:
            text = fold(text)
        return b"".join(map(self.words.__getitem__, (self.ascii if text.isascii() else self.any).findall(text)))

    def ids(self, text: str | None) -> bytes:
        """Ids of a text (None: of the empty text), 2 bytes each."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special.get(part) or self._plain(part) for part in self.cut.split(text) if part)


_kept: dict = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder a worker process."""
    if (path, kind) not in _kept:
        _kept[path, kind] = Encoder(path, kind)
    return _kept[path, kind]
