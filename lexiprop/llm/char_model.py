"""A character language model of a corpus, and Viterbi decoding of obfuscated words under it.

The model counts all character 4-grams of all texts. Letters a-z, "no letter" and "any
other byte" make 28 symbols, so the table has 28**4 cells whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprop.llm.common import texts_of

SYMBOLS = 28
ORDER = 4
OTHER = SYMBOLS - 1
_CELLS = SYMBOLS**ORDER
_BYTES_AT_ONCE = 1 << 22

# What a written character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "à": "a", "á": "a", "â": "a", "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e",
    "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "ö": "o",
    "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y",
    "а": "a", "с": "c", "е": "e", "і": "i", "о": "o", "р": "p", "ѕ": "s", "т": "t", "х": "x",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: Costs of the noisy channel (negative logarithms of guessed rates).
COST_LOOKS_LIKE, COST_DROPPED, COST_ANY, COST_SINGLE, COST_NEW_WORD = 1.0, 2.0, 4.0, 1.5, 0.5
#: ... of a look-alike sign at the start or end of a word that is plain punctuation; of a sign that ends a word.
COST_PUNCTUATION, COST_BREAK = 1.0, 1.0


def _byte_symbols() -> np.ndarray:
    table = np.zeros(256, np.int32)
    for i, c in enumerate(LETTERS, 1):
        table[ord(c)] = table[ord(c.upper())] = i
    table[128:] = OTHER
    return table


def count_ngrams(texts: Iterable[str | None]) -> np.ndarray:
    """Counts of all 4-grams; each text starts and ends with "no letter"."""
    table, out = _byte_symbols(), np.zeros(_CELLS, np.int64)
    pad = b" " * (ORDER - 1)
    held, size = [pad], 0

    def add() -> None:
        data = b"".join(held)
        # long data goes in pieces that overlap by three bytes, so each 4-gram counts once
        for i in range(0, len(data) - 3, _BYTES_AT_ONCE):
            s = table[np.frombuffer(data, np.uint8, min(_BYTES_AT_ONCE + 3, len(data) - i), i)]
            key = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
            out[:] += np.bincount(key, minlength=_CELLS)

    for text in texts:  # the padding between two texts ends one and starts the other
        held += [(text or "").encode(), pad]
        size += len(held[-2]) + 3
        if size >= _BYTES_AT_ONCE:
            add()
            held, size = [pad], 0
    if size:
        add()
    return out


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """4-gram counts over every whole text of ``docs`` (column ``text``).

    Each task adds up its rows; at most 28**4 rows reach the driver.
    """

    def run(batches):
        total = np.zeros(_CELLS, np.int64)
        for b in batches:
            total += count_ngrams(texts_of(b, 0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    grams = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long")
    found = grams.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_CELLS, np.int64)
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    return counts


def log_model(counts: np.ndarray, words: Iterable[str] = (), share: float = 0.2, prior: float = 4.0) -> np.ndarray:
    """``-log P(symbol | three before)`` as a ``(28**3, 28)`` table, interpolated over the orders.

    ``words`` (a learned vocabulary) make a second model that gets ``share`` of the probability.
    """

    def smooth(c: np.ndarray) -> np.ndarray:
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for n in range(1, ORDER + 1):
            k = c.reshape(-1, SYMBOLS, SYMBOLS ** (n - 1), SYMBOLS).sum(axis=(0, 1)) if n < ORDER else c.reshape(-1, SYMBOLS)
            back = np.tile(p, (SYMBOLS if n > 1 else 1, 1)) if n > 1 else p[None]
            k = k.reshape(SYMBOLS ** (n - 1), SYMBOLS).astype(float)
            p = (k + prior * back) / (k.sum(axis=1, keepdims=True) + prior)
        return p

    p = smooth(counts)
    own = list(words)
    if own:
        p = (1 - share) * p + share * smooth(count_ngrams(own))
    return -np.log(p)


def _symbol(c: str) -> int:
    return LETTERS.find(c) + 1 if c in LETTERS else OTHER if ord(c) > 127 else 0


def options(char: str, run: int) -> list[tuple[str, float]]:
    """What a run of one written character may stand for, with its cost."""
    if char in LETTERS:
        base = [(char, 0.0)]
    elif char in LOOKS_LIKE:
        base = [(x, COST_LOOKS_LIKE) for x in LOOKS_LIKE[char]]
        if char.isalpha():
            base.append((char, 0.0))
    elif char == "*" and run == 1:
        return [("", COST_DROPPED)] + [(x, COST_ANY) for x in LETTERS]
    elif char.isalnum():
        base = [(char, 0.0)]
    else:
        return [("", COST_DROPPED)]
    if run == 1:
        return base
    # two of a kind are likelier meant than not, more are as likely one as two
    return [(x, c + COST_SINGLE * (run == 2)) for x, c in base] + [(x * 2, c) for x, c in base]


@lru_cache(maxsize=1 << 14)
def _choices(char: str, run: int, edge: bool, spaced: bool, breaks: bool) -> list[tuple[str, float, tuple[int, ...]]]:
    """The options of a run with their symbols."""
    found = options(char, run)
    if edge and char in LOOKS_LIKE:
        found = [*found, ("", COST_PUNCTUATION)]
    if breaks and not edge and not char.isalnum():
        found = [*found, (" ", COST_BREAK)]
    if spaced:
        found = found + [(" " + x, c + COST_NEW_WORD) for x, c in found if x]
    return [(x, c, tuple(map(_symbol, x))) for x, c in found]


def _lattice(written: str, spaced: bool, edges: bool, breaks: bool = False) -> Iterator[list[tuple[str, float, tuple[int, ...]]]]:
    """The choices of each run of equal characters; of more than two of a kind the number doesn't matter."""
    runs = [(char, min(sum(1 for _ in group), 3)) for char, group in groupby(written)]
    inner = [i for i, (char, _) in enumerate(runs) if char.isalnum()] if edges else []
    for i, (char, run) in enumerate(runs):
        yield _choices(char, run, bool(inner) and not inner[0] <= i <= inner[-1], spaced, breaks)


def may_begin(written: str, beginnings: set[str], length: int, edges: bool = False, breaks: bool = False) -> bool:
    """False only if no restored text of a word can be one of, or start with one of, the texts whose first
    0 to ``length`` letters are ``beginnings``. With ``breaks`` a word may begin behind any sign."""
    found = {""}
    for choices in _lattice(written, False, edges, breaks):
        after = {(p + x)[:length] for p in found for x, _, _ in choices if x != " "}
        ended = any(x == " " for x, _, _ in choices)
        if ended and any(p and p in beginnings and p + " " in beginnings for p in found):
            return True  # a whole wanted word
        found = {t for t in after if t in beginnings} | ({""} if ended else set())
        if any(len(t) == length for t in found):
            return True
        if not found and not breaks:
            break
    return bool(found)


def decode(written: str, model: np.ndarray, spaced: bool = False, edges: bool = False, breaks: bool = False) -> str:
    """The likeliest restored text of an obfuscated word: Viterbi over the lattice of what each
    run of characters may stand for. The state is the last three symbols.

    ``spaced``: the characters stood apart, so a new word may begin before any of them.
    ``edges``: signs before the first and behind the last letter or digit may be plain punctuation.
    ``breaks``: a sign inside may end a word.
    """
    costs = memoryview(np.ascontiguousarray(model, np.float64).reshape(-1))  # plain floats, which are faster one by one
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    keep = SYMBOLS**2
    for choices in _lattice(written, spaced, edges, breaks):
        after: dict[int, tuple[float, str]] = {}
        for state, (cost, text) in states.items():
            for add, extra, symbols in choices:
                at, total = state, cost + extra
                for s in symbols:
                    total += costs[at * SYMBOLS + s]
                    at = at % keep * SYMBOLS + s
                if at not in after or (total, text + add) < after[at]:
                    after[at] = (total, text + add)
        states = after
    return min((cost + costs[at * SYMBOLS], text) for at, (cost, text) in states.items())[1].strip()
