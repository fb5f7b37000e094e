"""Token ids of whole texts with the tokenizers library, a few times faster than a call per text.

Blanks separate tokens of the word-level BPE used here, so a text's ids are the ids of its blank-separated chunks in
order. Each batch is split and dictionary-encoded by Arrow, only chunks not seen lately go to the library, and ids are
gathered by index. `separable()` tells from the tokenizer's own description whether this holds; else texts go whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bytesops as B

#: Chunks kept by a worker; beyond it the older half is forgotten.
CACHE_CHUNKS = 300_000


def separable(spec: dict) -> bool:
    """Whether ids never depend on what stands beyond a blank: blanks normalise to a space, and no piece holds one."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [x["type"] for x in norm.get("normalizers", [norm] if norm else [])]
    parts = pre.get("pretokenizers", [pre])
    split = parts[0] if parts else {}
    pattern = (split.get("pattern") or {}).get("Regex", "")
    blank_free = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in pattern and r"\s" not in pattern.replace(r"[^\s", "")
    return bool(blank_free and set(kinds) <= {"NFC", "Replace", "Lowercase"} and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])))


class Encoder:
    """Ids of text batches. A worker holds one for each tokenizer file."""

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = separable(spec)
        self.plain = None
        if self.fast and "Lowercase" in str(spec["normalizer"]):
            self.plain = Tokenizer.from_file(path)  # for chunks of small Latin-1 letters, which the steps left out don't change
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that the library has to split."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode_plain(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of small letters, in one call: each is one piece, so the piece's number tells them apart."""
        got = self.plain.encode(" ".join(chunks), add_special_tokens=False)
        ids = np.array(got.ids, "<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(np.array(got.word_ids), minlength=len(chunks)))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk."""
        if len(self.new) > CACHE_CHUNKS // 2:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = list(map(new.get, chunks))
        miss = [i for i, b in enumerate(out) if b is None]
        if miss:
            plain, rest = [], []
            for i in miss:
                c = chunks[i]
                b = old.get(c)
                if b is not None:
                    out[i] = new[c] = b
                elif self.plain is not None and c.isalpha() and c.islower() and max(c) <= "\xff":
                    plain.append(i)
                else:
                    rest.append(i)
            for encode, some in ((self._encode_plain, plain), (self._encode, rest)):
                if some:
                    for i, b in zip(some, encode([chunks[i] for i in some]), strict=True):
                        out[i] = new[chunks[i]] = b
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids as <u4, offsets of each text) for an array of strings."""
        texts = B.text_array(texts)
        if not self.fast:
            each = [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
            return (np.concatenate(each) if each else np.zeros(0, "<u4")), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        buf, offs = B.raw(texts)
        # In plain Latin-1 texts without "<|" (no marks that could compose, no added token) ids don't change with small
        # letters and a blank between a letter and its comma or full stop; both make chunks recur.
        if self.plain is not None and len(buf) and not (buf >= 0xC4).any() and not ((buf[:-1] == 0x3C) & (buf[1:] == 0x7C)).any():
            low = B.LOWER[buf]
            high = np.flatnonzero(low[:-1] == 0xC3) + 1
            high = high[(low[high] <= 0x9E) & (low[high] != 0x97)]
            low[high] += 0x20
            letter = (low >= 0x61) & (low <= 0x7A)
            sep = np.zeros(len(low), bool)
            sep[1:] = ((low[1:] == 0x2C) | (low[1:] == 0x2E)) & letter[:-1]
            cut = offs[(offs > 0) & (offs < len(low))]
            sep[cut] = False
            if sep.any():
                at = np.flatnonzero(sep)
                low = np.insert(low, at, 0x20)
                offs = offs + np.searchsorted(at, offs, "left")
            buf = low
        starts, ends, first = B.word_spans(buf, offs, B.NOT_BLANK)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        size = ends - starts
        o = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(buf[B.NOT_BLANK[buf]]))])
        d = words.dictionary_encode()
        code = d.indices.to_numpy()
        each = self._chunks(d.dictionary.to_pylist())
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        at = np.concatenate([[0], np.cumsum(n)])
        m = n[code]
        total = np.concatenate([[0], np.cumsum(m)])
        idx = np.arange(total[-1], dtype=np.int64)
        idx += np.repeat(at[code] - total[:-1], m)
        return flat[idx], total[first]

    def with_end(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ids(), with `end` after each text."""
        ids, offs = self.ids(texts)
        n = len(offs) - 1
        return np.insert(ids, offs[1:], np.uint32(end)).astype("<u4", copy=False), offs + np.arange(n + 1)
