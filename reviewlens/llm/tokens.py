"""Token ids of whole texts by the `word_bpe` tokenizer file, with pieces of words looked up once.

The tokenizer writes a text in lower case, cuts it by a pattern, drops white space and cuts each part on its
own, so the ids of a text are those of its parts. The parts of some texts are found together by Arrow's
functions, and the different ones looked up once each; what was looked up is kept
in a table of bounded size, and a part not seen yet goes through the file's model. Texts with
characters where this way could differ (anything beyond Latin, letters whose lower case is beyond it, control
separators, special tokens) go through the tokenizer whole.
"""

from __future__ import annotations

from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
KEPT_PARTS = 240_000
LONG_PART = 64

# The file's pattern.

_PART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# End of the fixed values.

# Beyond U+024F, or a letter whose lower case is: there the tokenizer's own functions decide.
_OTHER = r"[^\x00-\x{24f}]|[\x{130}\x{23a}\x{23e}]|[\x1c-\x1f]|<\|(?:startoftext|endoftext)\|>"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for every byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Table(dict):
    """A look-up that makes missing entries. When it is full it becomes the older half and a new one
    begins; what is asked for again moves over, so frequent entries stay."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG_PART:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str | None = None):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.letters = _byte_letters()
        self.parts = _Table(self._model, KEPT_PARTS)

    def _model(self, part: str) -> bytes:
        spelled = part if part.isascii() and part.isprintable() else part.encode().decode("latin1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each followed by a 0, and where each text begins; one more at the end."""
        whole = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False).astype(bool)
        marked = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(pa.array(whole), "", texts)), _PART, r"\0 ")
        lists = pc.utf8_split_whitespace(marked)
        coded = lists.flatten().dictionary_encode()
        part = coded.indices.to_numpy(zero_copy_only=False)
        # Different parts, the ids of each end to end; white space at an end is an empty part without ids.
        known = list(map(self.parts.__getitem__, coded.dictionary.to_pylist()))
        ids, lengths = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int32, len(known)) // 4
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        each = lengths[part]
        after = np.cumsum(each, dtype=np.int32)
        flat = ids[np.repeat(starts[part] - after + each, each) + np.arange(after[-1] if len(after) else 0, dtype=np.int32)]
        # What stands behind the parts of each text: nothing but the closing id, or the ids of a whole text and it.
        ends = np.append(0, after)[lists.offsets.to_numpy()[1:]]
        closing = np.zeros(1, "<u4")
        behind = [np.append(self._whole(texts[i].as_py()), closing) if w else closing for i, w in enumerate(whole.tolist())] if whole.any() else None
        more = np.array([len(b) for b in behind]) if behind else 1
        out = np.insert(flat, np.repeat(ends, more), np.concatenate(behind) if behind else 0)
        return out, np.append(0, ends + np.cumsum(np.broadcast_to(more, len(texts))))


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
