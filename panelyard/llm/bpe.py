"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

A word is a string of base symbols; the last one carries the end-of-word mark.  An
Aho-Corasick automaton of the reversed tokens reads the reversed word once and gives the
longest token that starts at every position.  The encoder takes the longest token, checks
it against the token before it in the pair-compatibility table, steps down to the next
shorter prefix token where they do not fit, and steps back where none does; positions
proved dead are never tried again.  Two tokens are compatible if the merge rules would not
have built another token across their border, so the tokens found are those of the merges.

White space separates words, so a text is a sequence of chunks between white space; a worker
remembers the ids of chunks it has seen, up to a bound, after which it starts anew.  What it
remembers goes when no task has come for some seconds: the same process serves what follows.
"""
from __future__ import annotations

import gc
import hashlib
import json
import re
import threading
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, give_back, tidy

#: Chunks and words, each, that a worker remembers: about 300 bytes for one of both.
REMEMBERED = 160_000
#: Token pairs whose compatibility a worker remembers.
PAIRS = 250_000
#: Seconds without a task after which a worker lets go of its encoders.
IDLE = 5.0
#: Texts longer than this are encoded and hashed in several steps.
STEP_TOKENS = 1 << 20
#: Texts whose ids are held at a time.
STEP_TEXTS = 1_000
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Characters that str.split() takes for white space and the tokenizer does not.
ODD = re.compile("[\x1c-\x1f]")


def byte_symbols() -> dict[int, str]:
    """The usual printable stand-ins of the 256 bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memory(dict):
    """Remembers the results of a function; at ``most`` entries the older half is let go."""

    def __init__(self, make: Callable[[str], object], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str):
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class Encoder:
    """Encoder and decoder of one word-level BPE vocabulary file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("type") != "BPE" or "Lowercase" not in steps or "NFC" not in steps:
            raise ValueError(f"{path} is no vocabulary of lower-cased NFC words")
        self.ids: dict[str, int] = model["vocab"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.word = regex.compile(splits[0])
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = {b: symbols[b] for b in range(256)}
        self._pairs(model["merges"])
        self._automaton()
        self._tables()
        self.words = Memory(self.word_of, remembered)
        self.memory = Memory(self.chunk_ids, remembered)

    def _symbols(self, token: str) -> str:
        """A token as one character per base symbol; marked ones are moved out of the way."""
        if self.mark and token.endswith(self.mark):
            body = token[: -len(self.mark)]
            return body[:-1] + chr(ord(body[-1]) + 0x10000) if body else token
        return token

    def _pairs(self, merges: list) -> None:
        """rank of every merge, and for every token the pair it was made of."""
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.rank.setdefault(pair, r)
            if whole not in self.made:
                self.made[whole], self.parts[whole] = r, pair

    def _automaton(self) -> None:
        forms = {self._symbols(t): i for t, i in self.ids.items()}
        self.size = {i: len(s) for s, i in forms.items()}
        self.machine = ahocorasick.Automaton()
        self.fits: dict[int, bool] = {}
        # Tokens that the merges cannot reach are left out.
        reached = {s: i for s, i in forms.items() if len(s) == 1 or (i in self.parts and self.compatible(*self.parts[i], self.made[i]))}
        for s, i in reached.items():
            self.machine.add_word(s[::-1], i)
        self.machine.make_automaton()
        self.shorter: dict[int, int] = {}
        for s, i in reached.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := reached.get(s[:n])) is not None:
                    self.shorter[i] = j
                    break

    def _tables(self) -> None:
        """Concatenated token texts and decimal ids, each with a space behind, and their offsets."""
        n = max([*self.ids.values(), *self.special.values()]) + 1
        names = [""] * n
        for t, i in (self.ids | self.special).items():
            names[i] = t
        self.texts = _joined([t.encode() for t in names])
        self.digits = _joined([str(i).encode() for i in range(n)])

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether the merges leave tokens a and b side by side.

        Both are taken apart along their border, the later merge first; the pair fits unless
        some pair across the border merges before the merges that built its two sides.
        ``below`` looks only at merges of a lower rank.
        """
        key = a << 32 | b
        if below is None and (known := self.fits.get(key)) is not None:
            return known
        last, good = 1 << 60 if below is None else below, True
        while True:
            if self.rank.get((a, b), 1 << 60) < last:
                good = False
                break
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # The side that was merged last is taken apart.  Among equal merges the leftmost
            # is done first: the border's own merge comes after one inside the left side and
            # before one inside the right side.
            if ra > rb:
                last, a = ra, self.parts[a][1]
            else:
                last, b = rb + 1, self.parts[b][0]
        if below is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[key] = good
        return good

    def word_of(self, w: str) -> bytes:
        s = w.encode().decode("latin-1").translate(self.inner)
        return _packed(self.word_ids(s[:-1] + chr(ord(s[-1]) + 0x10000) if self.mark else s))

    def word_ids(self, symbols: str) -> list[int]:
        """The tokens of one word given as base symbols."""
        n = len(symbols)
        size = self.size
        first = [0] * n
        # Of the tokens that end at one place of the reversed word, the longest comes first.
        for end, token in self.machine.iter(symbols[::-1]):
            if not first[n - 1 - end]:
                first[n - 1 - end] = token + 1
        alive = [True] * (n + 1)
        out: list[int] = []
        pos, token = 0, first[0] - 1
        while pos < n:
            end = pos + size[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                pos = end
                token = first[pos] - 1 if pos < n else 0
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                alive[pos] = False
                token = out.pop()
                pos -= size[token]
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a text without white space, packed as int32."""
        out: list[bytes] = []
        for part in self.apart.split(chunk) if self.apart else [chunk]:
            if part in self.special:
                out.append(_packed([self.special[part]]))
                continue
            plain = part if part.isascii() else unicodedata.normalize("NFC", part)
            low = plain.lower() if "Σ" not in plain else "".join(c.lower() for c in plain)
            for w in [low] if low.isascii() and low.isalpha() else self.word.findall(low):
                out.append(self.words[w])
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as int32."""
        chunks = SPACES.split(text) if ODD.search(text) else text.split()
        return np.frombuffer(b"".join(map(self.memory.__getitem__, chunks)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return spelled(ids, *self.texts).decode()


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8), ends


def spelled(ids: np.ndarray, text: np.ndarray, at: np.ndarray) -> bytes:
    """The entries of ``ids`` joined by one space, gathered through the offset table."""
    if len(ids) == 0:
        return b""
    lengths = at[ids + 1] - at[ids]
    ends = np.cumsum(lengths)
    where = np.repeat(at[ids] - ends + lengths, lengths) + np.arange(ends[-1])
    return text[where[:-1]].tobytes()


def digest(ids: np.ndarray, text: np.ndarray, at: np.ndarray) -> str:
    """SHA-256 of ``spelled``, in bounded steps."""
    h = hashlib.sha256()
    for i in range(0, len(ids), STEP_TOKENS):
        h.update((b" " if i else b"") + spelled(ids[i : i + STEP_TOKENS], text, at))
    return h.hexdigest()


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, remembered)


_lock = threading.Lock()
_tasks = 0
_timer: threading.Timer | None = None


@contextmanager
def lent(path: str, remembered: int = REMEMBERED, idle: float = IDLE) -> Iterator[Encoder]:
    """The encoder of this worker for the time of a task; ``idle`` seconds after the last one it is let go."""
    global _tasks, _timer
    with _lock:
        if _timer:
            _timer.cancel()
        _tasks, _timer = _tasks + 1, None
    try:
        yield encoder(path, remembered)
    finally:
        with _lock:
            _tasks -= 1
            if not _tasks:
                _timer = threading.Timer(idle, _let_go)
                _timer.daemon = True
                _timer.start()


def _let_go() -> None:
    with _lock:
        if not _tasks:
            encoder.cache_clear()
    # An encoder and its memories refer to each other.
    gc.collect()
    give_back()


@apart("text")
def encode_texts(df: DataFrame, path: str, text: str = "text", ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Add token_ids (if ``ids``), n_tokens, ids_sha256 and decoded_sha256 to every row.

    ``path`` is the vocabulary file, at the same place on every machine.  The text column is
    replaced by these; other columns pass through, but for input columns named like an
    output.  NULL counts as the empty text, which has no tokens.  Rows stay where they are:
    there is no shuffle, and a batch holds few texts when they are long.  ``remembered``
    trades memory of a worker for time.
    """
    names = ["token_ids"] * ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [c for c in df.columns if c != text and c.lower() not in names]
    d = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(path, remembered) as e:
            for b in (whole.slice(i, STEP_TEXTS) for whole in batches for i in range(0, whole.num_rows, STEP_TEXTS)):
                rows = [e.encode(t.as_py() or "") for t in b.column(len(keep))]
                cols = [pa.array(rows, pa.list_(pa.int32()))] if ids else []
                cols += [pa.array([len(r) for r in rows], pa.int64()), pa.array([digest(r, *e.digits) for r in rows], pa.string()), pa.array([digest(r, *e.texts) for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[*keep, *names])

    fields = {"token_ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = d.drop("_text").withColumns({n: F.lit(None).cast(fields[n]) for n in names}).schema
    return d.mapInArrow(tidy(run), schema)


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the decoded text of an id array; NULL decodes to the empty text."""
    keep = [c for c in df.columns if c != out]
    d = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(path) as e:
            for b in batches:
                texts = [e.decode(np.array(r or [], np.int64)) for r in b.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, out])

    return d.mapInArrow(run, d.drop("_ids").withColumn(out, F.lit("")).schema)
