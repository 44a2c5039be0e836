"""Encoding by a public tokenizer, with each distinct word encoded once per worker.

The tokenizer of ``VOCABULARY`` drops white space and never joins characters across it, so the
ids of a text are the ids of its chunks between ASCII white space, one after another; special
tokens hold no white space either. It lower-cases by itself; doing that first, where all
characters are of Latin-1 and no composing or context is involved, leaves fewer distinct chunks.
A chunk of letters with ASCII marks behind them is two pieces to the tokenizer, so distinct
chunks are split that way and only distinct words are encoded, by the merges of the
tokenizer's model alone: there is nothing left in them to normalise or to cut. A worker
keeps the ids of up to ``KEPT`` words as bytes; what it has not asked for lately goes first.
All else is done on whole Arrow columns.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandloom.llm.common import worker_cache

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
KEPT = 700_000
#: Longer chunks are encoded each time, so that the memory for kept ones has a bound.
LONGEST = 64
#: Characters of texts that are taken together.
PART_CHARS = 2 << 20
#: Chunks in one call of the tokenizer.
TOGETHER = 32


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)}


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], ... starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.bytes = byte_letters()
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Another kind of vocabulary, whose model alone gives other ids, is asked as a whole.
        probes = ["a", "word", "kindergartens", "straße", "déjà", "ñandú", "öffentlichkeit", "x" * 40]
        self.direct = [self._letters(w) for w in probes] == self._whole(probes)

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.merge(word)]).tobytes()

    def _whole(self, chunks: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(chunks), TOGETHER):
            got = self.tokenizer.encode_batch_fast(chunks[at : at + TOGETHER], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in got]
        return out

    def _look_up(self, chunks: list[str], letters: bool) -> list[bytes]:
        """Chunks seen lately stay: when half of the room is full, what was not asked for since the last time goes."""
        if len(self.ids) > KEPT // 2:
            self.older, self.ids = self.ids, {}
        parts: list = list(map(self.ids.get, chunks))
        new = [i for i, p in enumerate(parts) if p is None]
        older, unknown = self.older.get, []
        for i in new:
            if (p := older(chunks[i])) is None:
                unknown.append(i)
            else:
                parts[i] = p
        asked = [chunks[i] for i in unknown]
        got = list(map(self._letters, asked)) if letters and self.direct else self._whole(asked)
        for i, p in zip(unknown, got, strict=True):
            parts[i] = p
        self.ids.update((chunks[i], parts[i]) for i in new if len(chunks[i]) <= LONGEST)
        return parts

    def _pool(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks: a pool of ids, and where in it each chunk starts and how many it has."""
        cut = pc.extract_regex(distinct, _WORD_MARKS)
        whole = np.asarray(pc.is_null(cut))
        n = len(distinct)
        parts, atoms = [], np.empty((n, 2), np.int64)
        for column, values, letters in ((0, cut.field(0), True), (1, cut.field(1), False), (0, distinct, False)):
            rows = np.flatnonzero(whole if values is distinct else ~whole)
            coded = values.take(pa.array(rows)).dictionary_encode()
            atoms[rows, column] = coded.indices.to_numpy(zero_copy_only=False) + len(parts)
            parts += self._look_up(coded.dictionary.to_pylist(), letters)
        atoms[whole, 1] = len(parts)
        parts.append(b"")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        flat = atoms.reshape(-1)
        ids = pool[_spans(starts[flat], sizes[flat])]
        n_ids = sizes[atoms].sum(axis=1)
        return ids, np.cumsum(n_ids) - n_ids, n_ids

    def _columns(self, split: pa.Array) -> list[bytes]:
        """The ids of texts that come as lists of chunks."""
        coded = split.flatten().dictionary_encode()
        pool, starts, sizes = self._pool(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[code]
        ids, ends = pool[_spans(starts[code], n)], np.concatenate(([0], np.cumsum(n)))
        cuts = ends[np.asarray(split.offsets) - split.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _part(self, texts: list[str]) -> list[bytes]:
        plain = [_plain(t) for t in texts]
        if all(plain):
            return self._columns(pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string()))))
        some = iter(self._part([t for t, p in zip(texts, plain, strict=True) if p])) if any(plain) else iter(())
        rest = iter(self._columns(pa.array([chunks(t) for t, p in zip(texts, plain, strict=True) if not p], pa.large_list(pa.large_string()))))
        return [next(some if p else rest) for p in plain]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit words; null is empty."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= PART_CHARS:
                out += self._part(part)
                part, size = [], 0
        return out + (self._part(part) if part else [])


#: Small letters of Latin-1, with the ASCII marks behind them if any: two pieces to the tokenizer.
_WORD_MARKS = r"^(?P<word>[a-zß-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: What str.split() takes for white space beside the ASCII one, within Latin-1.
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0"
_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def _plain(text: str) -> bool:
    """Whether all characters are of Latin-1 and white space is the ASCII one, without special tokens."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not any(c in text for c in _ODD) and "<|" not in text


def chunks(text: str) -> list[str]:
    if _plain(text):
        return text.lower().split()
    return [c for c in text.translate(_SPACES).split(" ") if c]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, for as long as the worker's tasks encode."""
    return worker_cache(f"tokens {path}", lambda: Encoder(path))
