"""Token ids of whole texts by a public tokenizer file.

Library encoding of a whole text costs microseconds per word, and the same
words come again and again.  For a tokenizer that works on units between
white space (:data:`SAFE_TEXT` lists where that is provably so) a task keeps
a bounded memo from unit to ids, so only unseen words reach the library.
Every other text is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# Characters for which Unicode NFC leaves a text unchanged, one character is
# lower-cased by itself, and white space is the same for every library.
UNSAFE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-įı-ɏ]")


# Fixed value: the unit pattern of CLIP's tokenizer.  A unit of letters is one match of it, and so is a run of these
# marks behind one.
LETTER_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
MARKS = ".,;:!?)(]}[{\"-_/*#"


class Memo:
    """A bounded map with two generations: a full young one becomes the old
    one, and what is asked again moves back to the young."""

    def __init__(self, items: int):
        self.items, self.young, self.old = items, {}, {}

    def age(self) -> None:
        if len(self.young) > self.items:
            self.old, self.young = self.young, {}

    def recall(self, keys: set[str]) -> set[str]:
        """Make ``keys`` known where the old generation has them; the rest."""
        old = self.old
        keys = keys.difference(self.young)
        known = keys & old.keys()
        self.young.update((k, old[k]) for k in known)
        return keys - known


class Encoder:
    """Encodes texts to little-endian ids (``dtype``) without special tokens.

    ``memo_items`` bounds each generation of the memo."""

    def __init__(self, path: str, memo_items: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = Memo(memo_items)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.split = self._unit_split(spec)
        self.letters = self.split is not None and self.split.pattern == LETTER_PATTERN
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.tok.get_vocab_size(), bool)  # ids that end a piece
        if self.split is not None:
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    @staticmethod
    def _unit_split(spec: dict):
        """The pattern of a tokenizer that lower-cases, drops white space
        and encodes each match of one pattern by itself; else None."""
        import regex
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if (norms == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
                and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]
                and not spec.get("post_processor") and spec["model"].get("end_of_word_suffix")):
            return regex.compile(steps[0]["pattern"]["Regex"])
        return None

    def _pieces(self, unit: str) -> list[str]:
        """The matches of the pattern in a unit."""
        if self.letters:
            core = unit.rstrip(MARKS)
            if core.isalpha():
                return [core, unit[len(core):]] if len(core) < len(unit) else [unit]
        return self.split.findall(unit)

    def _learn(self, units: set[str]) -> None:
        """Make all ``units`` known.  A piece alone is a unit with the same
        ids, so one memo holds both."""
        rest = self.memo.recall(units)
        whole = {u for u in rest if u.isalpha()} if self.letters else set()
        parts = {u: self._pieces(u) for u in rest - whole}
        known = self.memo.young
        new = list(self.memo.recall(whole.union(*parts.values())))
        for at in range(0, len(new), 5000):
            some = new[at:at + 5000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't encode pieces one by one")
            raw, wide, lo = ids.tobytes(), self.dtype.itemsize, 0
            for p, hi in zip(some, (ends * wide).tolist()):
                known[p] = raw[lo:hi]
                lo = hi
        get = known.__getitem__
        for u, ps in parts.items():
            if u not in known:
                known[u] = b"".join(map(get, ps))

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """Ids of each text as bytes, ``end`` appended to each."""
        out: list[bytes | None] = [None] * len(texts)
        rest, plain, units = [], [], []
        for k, t in enumerate(texts):
            if self.split is None or UNSAFE.search(t) or any(s in t for s in self.special):
                rest.append(k)
            else:
                plain.append(k)
                units.append(t.lower().split())
        if plain:
            self.memo.age()
            self._learn(set().union(*units).difference(self.memo.young))
            get = self.memo.young.__getitem__
            for k, us in zip(plain, units):
                out[k] = b"".join(map(get, us)) + end
        if rest:
            for k, e in zip(rest, self.tok.encode_batch([texts[k] for k in rest], add_special_tokens=False)):
                out[k] = np.array(e.ids, self.dtype).tobytes() + end
        return out  # type: ignore[return-value]


# Items of a memo's generation; a unit with its ids takes about 200 bytes.
MEMO_ITEMS = 500_000

_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo_items: int = MEMO_ITEMS) -> Encoder:
    """One encoder per worker process, file and size of its memo."""
    key = (path, memo_items)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, memo_items)
    return _ENCODERS[key]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
