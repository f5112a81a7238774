"""BPE encoding by depth-first traversal of a prefix-sharing trie, and decoding.

Words of a batch that were not met before make a trie, so a prefix shared by many
words is one path. The last token of a prefix's encoding is determined by the prefix
alone, and a sequence is the BPE encoding exactly if each neighbouring pair of tokens
stays apart when merged on its own. So the traversal stores in each node only its last
token: the one suffix of the path that is a token and stays apart from the last token of
the node where it begins. Walking back from a word's end gives its ids; shared prefixes
are computed once.

Encoding and decoding follow the tokenizer file: added tokens found in the raw text, NFC,
white space to one space, lower case, split into letter runs, single numbers and symbol
runs, bytes shown as letters, word-end suffix; decoding joins the tokens with spaces (the
file has no decoder). Results for a word are kept per Python worker in a bounded memo,
which only saves time.

Defined cases: null text is the empty text and has no tokens; other columns are ignored;
rows may repeat; equal texts get equal ids; texts of any length are read whole, and what a worker
remembers is bounded in entries and characters; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from readloom.llm.common import small_batches

#: Distinct chunks between white space that a worker remembers, and their characters.
MEMO_CHUNKS, MEMO_CHARS = 400_000, 16_000_000
#: Characters of text that are encoded at a time.
STEP_CHARS = 6_000_000

# Fixed values of the tokenizer file's normalizer and pre-tokenizer.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
#: Symbols that often end a word; a run of them is one piece.
_STOPS = ".,;:!?"
_SPACES = regex.compile(f"[{_WHITE}]+")
#: Characters that Python's str.split() takes for white space and the tokenizer does not.
_ODD_SPACES = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges, and which neighbouring tokens stay apart."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = self.ids[a + b]
            self.rank[self.ids[a], self.ids[b]] = n
            self.parts.setdefault(whole, (self.ids[a], self.ids[b]))
        self.letters = byte_letters()
        self._begins = {t[:i] for t in self.ids for i in range(len(t) + 1)}
        self._steps: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._apart: dict[int, bool] = {}
        self._sound: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its parts along one edge, each with the rank of the merge that takes it up."""
        if (key := (token, side)) not in self._spines:
            spine, taken, at = [], len(self.rank), token
            while True:
                spine.append((at, taken))
                if at not in self.parts:
                    break
                taken, at = self.rank[self.parts[at]], self.parts[at][side]
            self._spines[key] = spine
        return self._spines[key]

    def _crossed(self, left: int, right: int, before: int) -> bool:
        """Whether a merge of rank under before joins parts across the border of two tokens.

        The parts a (right edge of left) and b (left edge of right) can merge at rank r while
        neither has been taken up by its own token; at equal rank the leftmost merge goes first.
        """
        for a, a_taken in self._spine(left, 1):
            for b, b_taken in self._spine(right, 0):
                r = self.rank.get((a, b))
                if r is not None and r < before and r < a_taken and r <= b_taken:
                    return True
        return False

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE on both tokens' text gives just these two tokens."""
        key = left << 20 | right
        if (known := self._apart.get(key)) is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            known = self._apart[key] = not self._crossed(left, right, len(self.rank))
        return known

    def sound(self, token: int) -> bool:
        """Whether BPE on the token's own text gives the token."""
        if (known := self._sound.get(token)) is None:
            if token not in self.parts:
                known = True
            else:
                a, b = self.parts[token]
                r = self.rank[a, b]
                known = self.sound(a) and self.sound(b) and not self._crossed(a, b, r)
            self._sound[token] = known
        return known

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of each word (shown as letters, without the word-end suffix).

        The words in sorted order are their trie in depth-first order: going from one word to the
        next leaves the path at their longest common prefix, and only the nodes below it are new.
        path, last and size hold the nodes from the root to the current one.
        """
        found: dict[str, list[int]] = {}
        steps, known, apart, end = self._steps, self._apart, self.apart, self.end
        path: list[str] = [""]  # automaton state of each prefix
        last: list[int] = []  # last token of each prefix, and its number of symbols
        size: list[int] = []
        above = ""
        for word in sorted(words):
            inner = len(word) - 1  # the last letter has the suffix: a node of its own, which no other word shares
            depth, shared = 0, min(inner, len(last))
            while depth < shared and word[depth] == above[depth]:
                depth += 1
            del last[depth:], size[depth:], path[depth + 1 :]
            state = path[depth]
            n = depth
            while n <= inner:
                text = state + word[n] if n < inner else state + word[inner] + end
                n += 1
                step = steps.get(text)
                if step is None:
                    step = self._step(text)
                for token, symbols in step[1]:
                    if symbols == n:
                        break
                    if symbols < n:
                        before = last[n - symbols - 1]
                        stays = known.get(before << 20 | token)
                        if apart(before, token) if stays is None else stays:
                            break
                else:
                    raise ValueError(f"no token ends the prefix of {n} letters of {word!r}")
                if n <= inner:
                    state = step[0]
                    path.append(state)
                    last.append(token)
                    size.append(symbols)
            out, at = [token], inner + 1 - symbols
            while at:
                out.append(last[at - 1])
                at -= size[at - 1]
            out.reverse()
            found[word] = out
            above = word
        return found

    def forget(self) -> None:
        """Bounds what is remembered of states; they are computed anew when they are met again."""
        if len(self._steps) > MEMO_CHUNKS:
            self._steps.clear()

    def _step(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """Longest suffix of text that begins a token, and all tokens that end text, longest first."""
        state = text
        while state not in self._begins:
            state = state[1:]
        ends = []
        for start in range(len(state)):
            token = self.ids.get(state[start:])
            if token is not None and self.sound(token):
                letters = len(state) - start
                ends.append((token, letters - len(self.end) if self.end and state.endswith(self.end) else letters))
        self._steps[text] = state, ends
        return self._steps[text]


class Encoder:
    """Encodes and decodes whole texts; remembers the chunks it has met."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        whole = Tokenizer.from_file(path)
        self._hidden = {b: shown for b, shown in self.vocabulary.letters.items() if chr(b) != shown}
        self._normal, self._split = whole.normalizer, whole.pre_tokenizer
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.chars = 0
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self._added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        names = self.vocabulary.names
        self._names = [names.get(i, "") for i in range(max(names) + 1)]

    def _pieces(self, chunk: str) -> list[str]:
        """The words of a chunk, lower-cased, their bytes shown as letters.

        Up to U+024F every version of Unicode agrees; beyond it the library that the file is made for says
        what is composed, what lower case is and which characters are letters or numbers.
        """
        if not chunk.isascii():
            if max(chunk) >= "\u0250":
                return [piece for piece, _ in self._split.pre_tokenize_str(self._normal.normalize_str(chunk))]
        elif chunk.isalpha():
            return [chunk.lower()]
        lowered = chunk.lower()
        word = lowered.rstrip(_STOPS)
        if word.isalpha():  # the common case, without the pattern
            found = [word, lowered[len(word) :]] if len(word) < len(lowered) else [word]
        else:
            found = _SPLIT.findall(lowered)
        if chunk.isascii() and chunk.isprintable():
            return found  # these bytes are shown as themselves
        return [piece.encode().decode("latin-1").translate(self._hidden) for piece in found]

    def learn(self, chunks: set[str]) -> None:
        """Puts chunks (runs without white space) into the memo, by one trie of their new words."""
        pieces = [self._pieces(chunk) for chunk in chunks]
        wanted = {p for ps in pieces for p in ps}
        new = wanted.difference(self.words)
        if len(self.words) + len(new) > MEMO_CHUNKS:
            self.words.clear()
            new = wanted
        self.vocabulary.forget()
        for word, ids in self.vocabulary.encode_words(new).items():
            self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
        get = self.words.__getitem__
        for chunk, ps in zip(chunks, pieces, strict=True):
            self.memo[chunk] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))

    def _chunks(self, text: str) -> list[str]:
        return [c for c in _SPACES.split(text) if c] if _ODD_SPACES.search(text) else text.split()

    def _segments(self, text: str) -> list[str]:
        """Text and added tokens in turn."""
        return self._added.split(text) if self._added and "<|" in text else [text]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        wanted: set[str] = set()
        for text in texts:
            for segment in self._segments(text)[::2]:
                wanted.update(self._chunks(segment))
        new = wanted.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_CHUNKS or self.chars > MEMO_CHARS:
            self.memo.clear()
            self.words.clear()
            self.chars, new = 0, wanted
        self.chars += sum(map(len, new))
        if new:
            self.learn(new)
        get, added, out = self.memo.__getitem__, self.vocabulary.added, []
        for text in texts:
            parts = self._segments(text)
            if len(parts) == 1:
                out.append(b"".join(map(get, self._chunks(text))))
            else:
                out.append(b"".join(np.uint32(added[s]).tobytes() if i % 2 else b"".join(map(get, self._chunks(s))) for i, s in enumerate(parts)))
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self._names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def _lists(coded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))


def _run(batches: Iterator[pa.RecordBatch], path: str, arrays: bool) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        at = 0
        while at < batch.num_rows:
            texts, chars = [], 0
            while at + len(texts) < batch.num_rows and (not texts or chars < STEP_CHARS):
                texts.append(column[at + len(texts)].as_py() or "")
                chars += len(texts[-1])
            coded = coder.encode_all(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(texts)),
                    _lists(coded) if arrays else pa.array(coded, pa.binary()),
                    pa.array(map(coder.decode, coded), pa.string(), size=len(texts)),
                ],
                names=["doc_id", "ids", "decoded"],
            )
            at += len(texts)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", arrays: bool = False) -> DataFrame:
    """doc_id, ids and decoded, the text decoded from them.

    ids are little-endian unsigned 32-bit integers in a binary, or with arrays an array<int>.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(
        lambda batches: _run(batches, path, arrays), f"doc_id bigint, ids {'array<int>' if arrays else 'binary'}, decoded string"
    )
