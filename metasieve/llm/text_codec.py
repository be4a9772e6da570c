"""Exact token ids at the speed of a word table.

A subword encoder cuts a text into chunks first and encodes each chunk alone.
Where that cut falls only at white space, a chunk's ids do not depend on its
neighbours, so each distinct chunk is encoded once by the tokenizer's library
and looked up afterwards. Texts with characters whose classes could differ
between regex engines, or with strings of added tokens, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, ASCII and precomposed Latin letters: unchanged by NFC, with the
#: same classes and lower case in every engine (U+0130 is left out).
_OUTSIDE = re.compile("[^\t\n\r -~\xa1-\u012f\u0131-\u017f]")
_INSIDE_LATIN1 = b"\t\n\r" + bytes(range(0x20, 0x7F)) + bytes(range(0xA1, 0x100))
_CHUNKS = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: Within those characters: letters and numbers as Unicode classes them.
_L, _N = r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]", r"[0-9\xb2\xb3\xb9\xbc-\xbe]"
_OTHER = rf"(?:(?!{_L}|{_N})\S)+"
_SHORT = r"'s|'t|'re|'ve|'m|'ll|'d"
_PIECES = {
    "words": re.compile(rf"{_SHORT}|{_L}+|{_N}|{_OTHER}"),
    "spaces": re.compile(rf"{_SHORT}| ?{_L}+| ?{_N}+| ?{_OTHER}|\s+(?!\S)|\s+"),
}


def _no_letters() -> str:
    """What of a lower-cased text is no word of letters, within those characters: the pattern in Arrow's syntax."""
    inside = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180))]
    numbers = [c for c in inside if re.match(_N, c)]
    others = [c for c in inside if not re.match(_L, c) and c not in numbers]
    return rf"({_SHORT}|[{re.escape(''.join(numbers))}]|[{re.escape(''.join(others))}]+)"


_NO_LETTERS = _no_letters()
_LONGEST_KEPT = 48
#: Texts whose distinct pieces are looked up together have so many characters at most, unless it is one text.
_GROUP_CHARS = 1 << 20


class _Known(dict):
    """Values of chunks; a chunk not met before is worked out on first use."""

    def __init__(self, bpe, cut: str, ids: bool):
        self.tokenize, self.lead, self.find = bpe.tokenize, "" if cut == "words" else "Ġ", _PIECES[cut].findall
        self.spaces, self.ids = cut == "spaces", ids

    def piece(self, mapped: str) -> object:
        """One piece, in the characters of a byte-level vocabulary, by the library's model."""
        found = [t.id for t in self.tokenize(mapped)]
        return _PACK[len(found)](*found) if self.ids and len(found) < len(_PACK) else np.array(found, "<u4").tobytes() if self.ids else len(found)

    def __missing__(self, k: str) -> object:
        if k.isalpha():
            value = self.piece(self.lead + (k if k.isascii() else _mapped(k)))
        elif k[-1:] in _ENDS and k[:-1].isalpha():
            value = self[k[:-1]] + self["\0" + k[-1] if self.spaces else k[-1]]
        else:
            plain = k if not self.spaces else k[1:] if k[:1] == "\0" else " " + k
            parts = [self.piece(_mapped(x)) for x in self.find(plain)]
            value = b"".join(parts) if self.ids else sum(parts)
        if len(k) <= _LONGEST_KEPT:
            self[k] = value
        return value


class _Words(_Known):
    """Ids of the pieces of lower-cased texts; those used again stay when it is thinned."""

    def __init__(self, bpe):
        super().__init__(bpe, "words", True)
        self.used = Counter()

    def __missing__(self, k: str) -> bytes:
        value = self.piece(k if k.isascii() else _mapped(k))
        if len(k) <= _LONGEST_KEPT:
            self[k] = value
        return value

    def count(self, pieces: Iterable[str], uses: Iterable[int]) -> None:
        self.used.update({k: n for k, n in zip(pieces, uses, strict=True) if k in self})

    def thin(self, most: int) -> None:
        """Keeps the ``most`` pieces used most at most; uses so far count half from now on."""
        uses = np.fromiter(self.used.values(), np.int64, len(self.used))
        least = int(np.partition(uses, -most - 1)[-most - 1]) if len(uses) > most else 0
        self.used = Counter({k: n // 2 for k, n in self.used.items() if n > least})
        kept = [(k, self[k]) for k in self.used]
        self.clear()
        self.update(kept)


class ChunkCoder:
    """Token ids (``<u4`` bytes) or token counts of whole texts.

    ``path`` names a ``.json`` file of `tokenizers` or a ``.model`` file of
    `sentencepiece`. About ``most_kept`` chunks stay in memory.
    """

    def __init__(self, path: str, ids: bool, most_kept: int = 100_000):
        self.want_ids, self.most_kept = ids, most_kept
        self.zero = b"" if ids else 0
        self.cut, self.added, self.known = None, [], {}
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].lower() for t in spec.get("added_tokens") or []]
        if (cut := _cut_of(spec)) is not None:
            self.cut, self.known = cut, _Words(self.model.model) if ids and cut == "words" else _Known(self.model.model, cut, ids)

    def _library(self, texts: list[str]) -> list[object]:
        if hasattr(self.model, "encode_batch_fast"):
            found = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            found = self.model.encode(texts, num_threads=1)
        return [np.array(x, "<u4").tobytes() for x in found] if self.want_ids else [len(x) for x in found]

    def _chunks(self, text: str) -> list[str] | None:
        """Chunks by the table's keys, or None if the library must do the text.

        Where chunks are cut at spaces, a key stands for itself with a space in
        front; one that begins with NUL stands for the rest alone.
        """
        if self.cut is None or not _inside(text):
            return None
        low = text.lower()
        if any(s in low for s in self.added):
            return None
        if self.cut == "words":
            return low.split()
        if _space_beside_space(text):
            return [c[1:] if c[0] == " " and len(c) > 1 else "\0" + c for c in _CHUNKS.findall(text)]
        parts = text.split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts, in order; each distinct piece of them is looked up once."""
        if len(self.known) > self.most_kept:
            self.known.thin(self.most_kept // 2)
        lows = [t.lower() if _inside(t) else None for t in texts]
        lows = [None if t is None or any(s in t for s in self.added) else t for t in lows]
        # letters are pieces by themselves once all else stands apart; the white space left is ASCII
        apart = pc.replace_substring_regex(pa.array(lows, pa.large_string()), pattern=_NO_LETTERS, replacement=r" \1 ")
        cut = pc.ascii_split_whitespace(apart)
        pieces = cut.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False)
        values = pa.array(list(map(self.known.__getitem__, distinct)), pa.large_binary())
        uses = np.bincount(pieces.indices.to_numpy(), minlength=len(distinct))
        self.known.count(distinct[uses > 1], uses[uses > 1].tolist())
        ids = values.take(pieces.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[cut.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        whole = memoryview(ids.buffers()[2] or b"")
        for text, low, start, end in zip(texts, lows, at, at[1:], strict=False):
            yield whole[start:end].tobytes() if low is not None else self._library([text])[0]

    def encode(self, texts: list[str]) -> Iterator[object]:
        """One value a text, in order."""
        if isinstance(self.known, _Words):
            first, size = 0, 0
            for i, text in enumerate(texts):
                if size and size + len(text) > _GROUP_CHARS:
                    yield from self._by_words(texts[first:i])
                    first, size = i, 0
                size += len(text)
            yield from self._by_words(texts[first:])
            return
        for text in texts:
            if len(self.known) > self.most_kept:
                self.known.clear()
            chunks = self._chunks(text) if text else []
            if chunks is None:
                yield self._library([text])[0]
            elif self.want_ids:
                yield b"".join(map(self.known.__getitem__, chunks))
            else:
                yield sum(map(self.known.__getitem__, chunks))


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print stand for themselves, the others for U+0100 onwards.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


_BYTE_CHARS = _byte_chars()
_ENDS = frozenset(".,;:!?-\"|*$#%&()'")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


def _mapped(piece: str) -> str:
    return "".join(map(_BYTE_CHARS.__getitem__, piece.encode()))


def _inside(text: str) -> bool:
    """Whether all characters are of the kind that needs no library."""
    try:
        return not text.encode("latin-1").translate(None, _INSIDE_LATIN1)
    except UnicodeEncodeError:
        return _OUTSIDE.search(text) is None


def _space_beside_space(text: str) -> bool:
    """Whether a space stands at an end or beside white space: the cut then depends on what follows."""
    return text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text


# How the public vocabularies that the table can stand for normalise and cut, whole.
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def _cut_of(spec: dict) -> str | None:
    """How the tokenizer described by ``spec`` cuts: at words, at spaces, or in a way that the library must do."""
    norm, pre, model = spec.get("normalizer"), dict(spec.get("pre_tokenizer") or {}), spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token"):
        return None
    steps = pre.get("pretokenizers") or [pre]
    last = {"type": steps[-1].get("type"), "prefix": steps[-1].get("add_prefix_space"), "regex": steps[-1].get("use_regex", True)}
    if norm is None and len(steps) == 1 and last == {"type": "ByteLevel", "prefix": False, "regex": True}:
        return "spaces"
    cuts = steps[:-1] == [_WORDS] and last == {"type": "ByteLevel", "prefix": False, "regex": False}
    return "words" if cuts and (norm or {}).get("normalizers") == _LOWER else None
