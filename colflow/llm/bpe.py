"""BPE encoding and decoding by prefix-sharing trie traversal.

A byte-pair encoding is valid exactly when each pair of neighbouring tokens is the
encoding of the two tokens' joined text. So the encoding of a prefix is known from
its last token alone: what is before it is the encoding of a shorter prefix. The
distinct words of a task form a trie; a depth-first walk carries one such state for
each node, and words that begin alike share the states of their common prefix.

Words are found by the tokenizer file's own normalizer and splitter; the merges are
applied here. The vocabulary has a fixed size, each task loads it from its path.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from colflow.llm.common import documents

#: bytes of a generation of remembered pieces in a worker (speed, not results)
MEMORY = 40 << 20
#: pairs of tokens whose fit a worker remembers (speed, not results), some 130 bytes each
PAIRS = 1 << 17
#: bytes of text that a worker cuts into pieces at a time; a longer text stays whole
CHUNK = 1 << 20
#: bytes of a remembered piece besides its characters and ids: two headers and a slot
ENTRY = 200


class TrieEncoder:
    """Encodes words (in the byte alphabet of the tokenizer) with the merges of the
    file at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        # no symbol holds a blank, so a blank separates the two of a merge
        self.rank = {m if isinstance(m, str) else " ".join(m): r for r, m in enumerate(model["merges"])}
        self.inner, self.last = self._suffixes()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.specials.items()}
        self.path = path
        self.kind = "H" if max(self.tokens) < 1 << 16 else "I"
        self.numbers = {i: str(i) for i in self.tokens}
        self.forget()
        # normalization changes no letter below U+0250 but its case, one at a time
        self.simple = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]*")
        # fixed value: the splitter's pattern, for texts of such letters
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        # fixed rule: printable Latin-1 bytes stand for themselves, the rest move up in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = (c for c in range(256) if c not in plain)
        self.bytes = {c: c for c in plain} | {c: 256 + n for n, c in enumerate(moved)}

    def forget(self) -> None:
        """Drops what was remembered of texts; the vocabulary stays."""
        self.fits: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    @cached_property
    def library(self):
        """The file's own normalizer and splitter, loaded for the first piece of text
        that needs more than the rules here."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def written(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.numbers.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def units(self, token: str) -> list[str]:
        """The single symbols that the merges start from."""
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1:] + self.end]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Plain byte-pair merging: the lowest rank first, from the left."""
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(f"{p[0]} {p[1]}", 1 << 60))
            if f"{best[0]} {best[1]}" not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _suffixes(self) -> tuple[dict, dict]:
        """Two tries of the tokens read backwards, inside and at the end of a word;
        under the key 0 stands the token's id."""
        inner, last = {}, {}
        for token, i in self.ids.items():
            ends = bool(self.end) and token.endswith(self.end)
            node = last if ends else inner
            for c in reversed(token[: -len(self.end)] if ends else token):
                node = node.setdefault(c, {})
            node[0] = i
        return inner, last if self.end else inner

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` can stand after ``before`` (-1: at a word's start)."""
        names = [self.tokens[before], self.tokens[token]] if before >= 0 else [self.tokens[token]]
        return self.merge([u for name in names for u in self.units(name)]) == names

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of each distinct word; the sorted order visits the trie depth
        first, ``path`` holds the states of the current branch: for each prefix its
        last token and where that begins, or None if it has no encoding."""
        out: dict[str, list[int]] = {}
        fits, tail = self.fits, self.end

        def state(word: str, depth: int, node: dict) -> tuple[int, int] | None:
            k = depth
            while k:
                k -= 1
                node = node.get(word[k])
                if node is None:
                    return None
                token = node.get(0)
                if token is not None and (before := path[k]) is not None:
                    key = (before[0] + 1) << 32 | token
                    known = fits.get(key)
                    if known is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        known = fits[key] = self.follows(before[0], token)
                    if known:
                        return token, k
            return None

        path: list[tuple[int, int] | None] = [(-1, 0)]
        previous = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(previous, word, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            n = len(word)
            for depth in range(len(path), n):
                path.append(state(word, depth, self.inner))
            found = state(word, n, self.last)
            tokens, at = [], n
            step = found
            while step and at:
                tokens.append(step[0])
                at = step[1]
                step = path[at]
            # a symbol outside the vocabulary leaves a gap: merge such a word directly
            out[word] = tokens[::-1] if not at else [self.ids[t] for t in self.merge(self.units(word + tail)) if t in self.ids]
            previous = word
        return out

    def split(self, chunk: str) -> list[str]:
        """Words of a piece of text, by the file's normalizer and splitter."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if chunk[:-1].isascii() and chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return [chunk[:-1].lower(), chunk[-1]]
        if self.simple.fullmatch(chunk):
            found = self.pattern.findall(chunk.lower())
            return [w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in found]
        lib = self.library
        return [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(chunk))]

    def pieces(self, text: str) -> list[str]:
        """``text`` cut at white space, special tokens apart. Neither the normalizer
        nor the splitter joins what white space separates."""
        for odd in "\x1c\x1d\x1e\x1f":
            if odd in text:
                return self._careful(text)
        if "<|" in text:
            return self._careful(text)
        return text.split()

    def _careful(self, text: str) -> list[str]:
        found = []
        marks = "|".join(map(regex.escape, self.specials)) or r"(?!)"
        for part in regex.split(f"({marks})", text):
            if part in self.specials:
                found.append(part)
            else:
                found += regex.findall(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", part)
        return found

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Of each of the distinct ``pieces`` its ids, packed. What was encoded before
        is remembered in two generations of ``MEMORY`` bytes: a full one becomes the
        old one, and what is still in use moves up from there."""
        known, fresh = {}, []
        for p in pieces:
            ids = self.young.get(p)
            if ids is None and (ids := self.old.get(p)) is not None:
                self._remember(p, ids)
            if ids is None:
                fresh.append(p)
            else:
                known[p] = ids
        plan = {p: self.split(p) for p in fresh if p not in self.specials}
        done = self.encode_words(list({w for ws in plan.values() for w in ws}))
        kind = self.kind
        for p, ws in plan.items():
            ids = done[ws[0]] if len(ws) == 1 else [i for w in ws for i in done[w]]
            known[p] = array(kind, ids).tobytes()
        for p in fresh:
            if p in self.specials:
                known[p] = array(kind, [self.specials[p]]).tobytes()
            self._remember(p, known[p])
        return known

    def _remember(self, piece: str, ids: bytes) -> None:
        size = ENTRY + len(piece) + len(ids)
        if self.held + size > MEMORY:
            self.young, self.old, self.held = {}, self.young, 0
        if size <= MEMORY:
            self.young[piece] = ids
            self.held += size

    def encode(self, texts: list[str]) -> Iterator[array]:
        """Token ids of each of ``texts``; their distinct pieces are encoded together."""
        cut = [self.pieces(t) for t in texts]
        known = self.learn(set().union(*cut))
        for pieces in cut:
            ids = array(self.kind)
            ids.frombytes(b"".join(map(known.__getitem__, pieces)))
            yield ids


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``CHUNK`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > CHUNK:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def encode_batches(path: str, emit: Callable[[TrieEncoder, pa.RecordBatch, Iterator[array]], pa.RecordBatch]):
    """A mapInArrow function: ``emit`` gets the encoder, a batch, and the ids of each
    of its texts; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in _chunks(whole):
                yield emit(enc, batch, enc.encode([t or "" for t in batch.column("text").to_pylist()]))
        # the worker outlives the partition: it keeps the vocabulary, not the texts'
        enc.forget()

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (token ids of the whole text) and ``decoded`` (their
    tokens joined by one space, as a file without decoder says). A null or empty
    text has no ids and decodes to the empty text; repeated rows stay."""

    def emit(enc, batch, encoded):
        ids = [list(i) for i in encoded]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded": pa.array([enc.decode(i) for i in ids], pa.string()),
            }
        )

    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return slim.mapInArrow(encode_batches(path, emit), "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` without
    sending the ids and texts back; rows as in ``encode_documents``."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def emit(enc, batch, encoded):
        rows = [(len(i), sha(enc.written(i)), sha(enc.decode(i))) for i in encoded]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                "ids_sha256": pa.array([r[1] for r in rows], pa.string()),
                "decoded_sha256": pa.array([r[2] for r in rows], pa.string()),
            }
        )

    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(encode_batches(path, emit), schema)


def op2_bpe(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return encoding_digests(documents(spark, sf_dir) if docs is None else docs, path)
