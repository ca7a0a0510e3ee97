"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is fixed by the last token of the encoding of each of its
prefixes: the encoding of prefix i ends with the one token t that is a suffix of the
prefix, fits behind the last token of prefix i - len(t), and is itself the encoding of
its own letters. So the distinct words of a batch go into a trie, a depth-first walk
carries the last-token state of every prefix, and a prefix that words share is computed
once. Words end with a marked symbol, so their last letter is an own edge.

Normalisation and word splitting follow the vocabulary file. Texts of the Latin range
take a regular expression with the same classes; every other text takes the
normaliser and splitter of the tokenizers library (only the model is ours).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revlens.llm.text import bounded_batches

# Bounds of a task's memory: words that are kept with their encoding, longest of them.
KEPT_WORDS = 200_000
KEPT_CHARS = 64
TAIL = 3
SHORT = tuple(range(TAIL - 1, 0, -1))
# Up to here Unicode is composed, lower case is per character, classes are settled.
LATIN_END = 0x250


def byte_letters() -> list[str]:
    """Printable letter of each byte: bytes that are printable Latin-1 stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _latin_pattern(contractions: list[str]) -> re.Pattern:
    def cls(ok) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN_END) if ok(chr(c)))
    letter = cls(lambda c: unicodedata.category(c)[0] == "L")
    number = cls(lambda c: unicodedata.category(c)[0] == "N")
    white = "\t-\r \x85\xa0"
    return re.compile(f"[{letter}]+|[{number}]|{'|'.join(contractions)}|[^{white}{letter}{number}]+")


class Vocabulary:
    """A BPE model with word ends, from the JSON of the tokenizers library."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("dropout"):
            raise ValueError("a deterministic BPE model with a word-end suffix is expected")
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.ids.items()}
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.letters = byte_letters()
        # Tokens by their letters; a token is usable if it is the encoding of its letters.
        self.inner: dict[str, str] = {}
        self.final: dict[str, str] = {}
        made = {a + b for a, b in merges} | set(self.letters) | {x + self.end for x in self.letters}
        for t in self.ids:
            if t in made:
                if t.endswith(self.end):
                    self.final[t[:-len(self.end)]] = t
                else:
                    self.inner[t] = t
        self.longest = max(map(len, [*self.inner, *self.final]))
        # Token lengths by the last TAIL letters (longest first): the suffixes worth a lookup.
        self.sizes: dict[int, dict[str, list[int]]] = {id(t): {} for t in (self.inner, self.final)}
        for table in (self.inner, self.final):
            for word in table:
                self.sizes[id(table)].setdefault(word[-TAIL:], []).append(len(word))
            self.sizes[id(table)] = {k: sorted({*v} | {*range(1, min(TAIL, len(k) + 1))}, reverse=True)
                                     for k, v in self.sizes[id(table)].items()}
        self.parts = {a + b: (a, b, k) for k, (a, b) in enumerate(merges)}
        if len(self.parts) != len(merges) or any(self.parts.get(x, (0, 0, -1))[2] >= k for k, m in enumerate(merges) for x in m):
            raise ValueError("each merge must make a new token of tokens made before it")
        self.fits: dict[tuple[str | None, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end):
            word = token[:-len(self.end)]
            return [*word[:-1], word[-1] + self.end]
        return [*token]

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE of a few symbols: lowest rank first, leftmost of equals."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.rank.get((a, b), len(self.rank)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """Parts of a token along its right (side 1) or left (side 0) edge, smallest
        first, each with the rank of the merge that takes it up."""
        found, rank, part = [], float("inf"), token
        while True:
            found.append((part, rank))
            if part not in self.parts:
                return found[::-1]
            rank = self.parts[part][2]
            part = self.parts[part][side]

    def can_follow(self, left: str | None, token: str) -> bool:
        """Whether encoding the letters of left + token gives these two tokens again.

        Both sides build up as they would alone unless a merge across the border comes
        first: it does if it ranks before what takes up the left part next and not
        after what takes up the right part (of equals the leftmost goes first).
        """
        if left is None:
            return self.merge(self.symbols(token)) == [token]
        lefts, rights, i, j = self.spine(left, 1), self.spine(token, 0), 0, 0
        while True:
            (a, taken), (b, then) = lefts[i], rights[j]
            across = self.rank.get((a, b))
            if across is not None and across < taken and across <= then:
                return False
            if taken <= then:
                if taken == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def _last(self, word: str, n: int, state: list, table: dict[str, str]) -> str:
        """Last token of the encoding of the first n letters, given the states before."""
        fits, get = self.fits, table.get
        for size in self.sizes[id(table)].get(word[max(0, n - TAIL):n], SHORT):
            at = n - size
            if at < 0:
                continue
            token = get(word[at:n])
            if token is not None:
                pair = (state[at], token)
                known = fits.get(pair)
                if known is None:
                    # a token that is not the encoding of its own letters is never used
                    known = self.can_follow(None, token) and (at == 0 or self.can_follow(*pair))
                    if len(fits) > KEPT_WORDS:
                        fits.clear()
                    fits[pair] = known
                if known:
                    return token
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, tokens) of distinct words in byte letters.

        Words in sorted order are the depth-first walk of their trie: the states of the
        prefix that a word shares with the one before stay on the stack.
        """
        state: list[str | None] = [None]   # state[i]: last token of the first i letters
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(state) - 1, len(before), len(word))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del state[shared + 1:]
            for n in range(shared + 1, len(word)):
                state.append(self._last(word, n, state, self.inner))
            before = word
            tokens = [self._last(word, len(word), state, self.final)]
            at = len(word) - len(tokens[0]) + len(self.end)
            while at:
                tokens.append(state[at])
                at -= len(state[at])
            yield word, tokens[::-1]


class Codec:
    """Encodes and decodes texts as the library does with the same file
    (no special tokens added, no truncation or padding)."""

    def __init__(self, spec: str):
        self.vocab = Vocabulary(spec)
        j = json.loads(spec)
        splits = [p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"]
        self.latin = _latin_pattern([x for x in pattern.split("|") if x.startswith("'")])
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]")
        self.special = re.compile("(" + "|".join(map(re.escape, self.vocab.special)) + ")") if self.vocab.special else None
        self.spec, self._library = spec, None
        self.kept: dict[str, bytes] = {t: self._packed([t]) for t in self.vocab.special}
        self.texts = [self.vocab.text.get(i, "") for i in range(max(self.vocab.text) + 1)]
        self.table = {b: c for b, c in enumerate(self.vocab.letters)}

    def _packed(self, tokens: list[str]) -> bytes:
        ids = [self.vocab.special[t] if t in self.vocab.special else self.vocab.ids[t] for t in tokens]
        return np.array(ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens, in byte letters, or (Latin words) as they are."""
        if not self.beyond.search(text):
            return self.latin.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_str(self.spec)
        normal = self._library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.vocab.letters)}
        return [bytes(back[c] for c in p).decode("utf-8") for p, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def words(self, text: str) -> list[str]:
        if self.special is None or "<" not in text:
            return self._pieces(text)
        out = []
        for part in self.special.split(text):
            if part in self.vocab.special:
                out.append(part)
            elif part:
                # an ordinary word never equals a special token: those are split off first
                out += self._pieces(part)
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodings of words that are not kept yet; long ones are returned only."""
        if len(self.kept) > KEPT_WORDS:
            self.kept = {t: self._packed([t]) for t in self.vocab.special}
        new = {w.encode("utf-8").decode("latin-1").translate(self.table): w for w in words}
        extra = {}
        for spelled, tokens in self.vocab.encode_words(list(new)):
            word = new[spelled]
            (self.kept if len(word) <= KEPT_CHARS else extra)[word] = self._packed(tokens)
        return extra

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null is empty. The new words of all given texts make one trie."""
        split = [self.words(t or "") for t in texts]
        found = [list(map(self.kept.get, words)) for words in split]
        new = {w for words, got in zip(split, found) if None in got for w, g in zip(words, got) if g is None}
        extra = self.learn(new) if new else {}
        for words, got in zip(split, found):
            if None in got:
                got = [extra[w] if g is None and w in extra else self.kept[w] if g is None else g for w, g in zip(words, got)]
            yield np.frombuffer(b"".join(got), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with special tokens kept; unknown ids are left out."""
        if len(ids) and int(ids.max()) >= len(self.texts):
            ids = ids[ids < len(self.texts)]
        return " ".join(map(self.texts.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary_path: str, arrays: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, with
    ``arrays``, ids array<int> and decoded string.

    Null texts are empty: no ids, empty decoding. Row-local: no shuffle; the vocabulary
    (a file of fixed size) goes out once as a broadcast variable. The decoded text is
    made from the ids alone.
    """
    bounded_batches(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema["doc_id"].dataType
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if arrays else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for b in batches:
            texts = b.column(1)
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256)
                ids = list(own.encode(part.to_pylist()))
                decoded = [own.decode(i) for i in ids]
                cols = [b.column(0).slice(lo, 256),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if arrays:
                    cols += [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, {schema}")


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, vocabulary(), arrays=False)
