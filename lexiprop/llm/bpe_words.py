"""Encoding by distinct words, for tokenizers that lower-case, drop white space and never join
across it: the ids of a text are those of its words, one after another."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from types import ModuleType

import numpy as np

#: The steps before BPE that this module knows how to do word by word (fixed values of the tokenizer file).
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Characters that NFC leaves alone and that have a lower case of one character each, and white space.
_SAFE = re.compile(r"[\x20\x09-\x0D!-~À-ÖØ-öø-ÿ]*+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x20\x09-\x0Da-z0-9ß-öø-ÿ]+")
_MARKS = re.compile(r"[^\x20\x09-\x0Da-z0-9ß-öø-ÿ]{2}")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_WORDS_AT_ONCE = 64
SEGMENT = 1 << 16


def tokenizer_text(path: str) -> str:
    """The tokenizer file's content, which travels with the tasks; refuses files of another kind."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    j = json.loads(text)
    steps = [x["type"] for x in j["normalizer"]["normalizers"]]
    split = j["pre_tokenizer"]["pretokenizers"][0]
    if steps != NORMALIZER or split["pattern"] != {"Regex": PATTERN} or split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError(f"{path}: this tokenizer does not work word by word")
    if any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in j["added_tokens"]):
        raise ValueError(f"{path}: a special token reaches beyond its word")
    return text


def load(text: str):
    # Spark runs a task on each core already; more threads in each only wait for one another
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


def segments(text: str | None, most: int = SEGMENT):
    """The text in pieces of about ``most`` characters, cut at white space."""
    text = text or ""
    at = 0
    while len(text) - at > most:
        m = _SPACE.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def words(segment: str) -> list[str]:
    """The words of a segment. Where it has unusual characters, or what might be a special token,
    those chunks between white space stay whole; the tokenizer splits them."""
    if _SAFE.fullmatch(segment) and "<|" not in segment:
        return _PIECES.findall(segment.lower())
    out: list[str] = []
    for raw in segment.encode().split():  # on bytes only ASCII white space splits
        chunk = raw.decode()
        if _SAFE.fullmatch(chunk) and "<|" not in chunk:
            out += _PIECES.findall(chunk.lower())
        else:
            out.append(chunk)
    return out


def _simple(chunk: str) -> bool:
    """Whether it is one word of the letters a to z."""
    return chunk.isascii() and chunk.isalpha() and chunk.islower()


def chunks(segment: str) -> list[str]:
    """Parts of a segment that are encoded one by one: words, or chunks that :func:`words` cuts
    further. Full stops and commas that stand alone are cut off here already, which makes most
    parts words."""
    if not _SAFE.fullmatch(segment) or "<|" in segment:
        return [c.decode() for c in segment.encode().split()]  # on bytes only ASCII white space splits
    low = segment.lower()
    if not _MARKS.search(low):
        low = low.replace(".", " . ").replace(",", " , ")
    return low.split()


class WordEncoder:
    """Ids of words; plain words are encoded many at a time."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        pieces = (tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size()))
        self.ends = [p.endswith("</w>") for p in pieces]  # the pieces that end a word

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        plain: list[int] = []
        odd: list[int] = []
        for i, w in enumerate(words):
            (plain if _simple(w) or _PIECES.fullmatch(w) else odd).append(i)
        lines = [plain[i : i + _WORDS_AT_ONCE] for i in range(0, len(plain), _WORDS_AT_ONCE)]
        found = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in line]) for line in lines], add_special_tokens=False)
        for line, e in zip(lines, found):
            ids = e.ids
            cuts = [k + 1 for k, i in enumerate(ids) if self.ends[i]]
            if len(cuts) != len(line) or cuts[-1] != len(ids):  # a word that ends otherwise
                odd += line
                continue
            for i, start, end in zip(line, [0, *cuts], cuts):
                out[i] = ids[start:end]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
            out[i] = e.ids
        return out


class Encoder:
    """Encodes texts; each distinct word is encoded once, as long as ``room`` lasts."""

    def __init__(self, tokenizer, dtype: str = "<u4", room: int = 1 << 20):
        self.coder, self.dtype, self.room = tokenizer if isinstance(tokenizer, WordEncoder) else WordEncoder(tokenizer), dtype, room
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        split = {c: [c] if _simple(c) else words(c) for c in new}
        unknown = list({w for ws in split.values() for w in ws if w not in self.known})
        ids = self.coder.encode(unknown)
        data = np.array([i for x in ids for i in x], self.dtype).tobytes()
        at, width = 0, np.dtype(self.dtype).itemsize
        for w, x in zip(unknown, ids):
            self.known[w] = data[at : at + width * len(x)]
            at += width * len(x)
        for c, ws in split.items():
            if c not in self.known:
                self.known[c] = b"".join([self.known[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers."""
        of, cut = [], []
        for i, t in enumerate(texts):
            for s in segments(t):
                of.append(i)
                cut.append(chunks(s))
        found = [list(map(self.known.get, cs)) for cs in cut]
        gaps = [i for i, f in enumerate(found) if None in f]
        self._learn(list({c for i in gaps for c, f in zip(cut[i], found[i]) if f is None}))
        for i in gaps:
            found[i] = [self.known[c] for c in cut[i]]
        out: list[list[bytes]] = [[] for _ in texts]
        for i, f in zip(of, found):
            out[i].append(b"".join(f))
        if len(self.known) > self.room:
            self.known.clear()
        return [b"".join(x) for x in out]


def _of_worker(key: str, make):
    """What this Python process keeps from task to task."""
    held = sys.modules.setdefault("_lexiprop_encoders", ModuleType("_lexiprop_encoders")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def worker_coder(text: str) -> WordEncoder:
    """The tokenizer of this Python process."""
    return _of_worker(f"{zlib.crc32(text.encode())}-{len(text)}", lambda: WordEncoder(load(text)))


def worker_encoder(text: str, dtype: str) -> Encoder:
    """The encoder of this Python process: the tasks that a worker runs share the words it knows."""
    return _of_worker(f"{zlib.crc32(text.encode())}-{len(text)}-{dtype}", lambda: Encoder(worker_coder(text), dtype))


def batches_of(texts: list[str | None], most: int = 1 << 21):
    """Slices of a list of texts, of about ``most`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
