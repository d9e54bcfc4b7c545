"""Byte-pair encoding along a trie of distinct words.

The last token of a word's encoding depends on the last tokens of its prefixes alone: it
is the one token t at the word's end for which the encoding of what stands before
ends in a token that t may follow. Two tokens may follow one another if no merge of the
vocabulary would join them across their border before each of them is made. So the
distinct words of a block are walked in sorted order, which is the depth-first order of
their trie: the states of a prefix that a word shares with the one before are still on
the stack and are not computed again. Ids are read off backwards from the word's end.

Decoding joins the bytes of the ids.

Cases: a null text is an empty one and has no ids. Special tokens in a text are single
ids, as in the library. Rows that repeat a doc_id, or have none, are encoded one by one.
An empty table gives no rows. Other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from logtide.llm.texts import CACHED_PIECES, blocks, byte_letters, id_and_text, tokenizer_path, worker_kept

#: Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60
CACHED_WORDS = 300_000  # distinct words whose ids a Python worker remembers, beside its pieces


class TrieEncoder:
    """Encodes and decodes with a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        self.ids = {spelled(token): i for token, i in vocabulary.items()}
        self.bytes = {i: token for token, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: text.encode() for text, i in self.special.items()}
        self.split_special = (
            regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        )
        self.words = regex.compile(PATTERN)
        self.wide = regex.compile(r"\s (?!\S)")
        self._spines(vocabulary, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]])
        self.ids = {token: i for token, i in self.ids.items() if i in self.right}
        # The longest token that ends in each four bytes: longer ones need not be looked up.
        self.reach: dict[bytes, int] = {}
        for token in self.ids:
            self.reach[token[-4:]] = max(len(token), self.reach.get(token[-4:], 0))
        self.sizes = {i: len(token) for i, token in self.bytes.items()}
        self.follows: dict[int, bool] = {}
        self.names = {i: f"{i}," for i in self.bytes}
        self.words_kept: dict[str, tuple[str, int, bytes]] = {}
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def _spines(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """Of every token the pieces at either edge, with the merge after which each is gone."""
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = vocabulary[a], vocabulary[b]
            self.rank.setdefault((left, right), rank)
            made.setdefault(vocabulary[a + b], (rank, left, right))
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for token in sorted(vocabulary.values(), key=lambda t: made[t][0] if t in made else -1):
            if token not in made:
                self.right[token] = self.left[token] = [(token, NEVER)]
                continue
            rank, a, b = made[token]
            # A token that its own bytes don't lead to can't be in any encoding.
            if a in self.right and b in self.left and self._first_join(a, b) == (rank, True):
                self.right[token] = [*self.right[b][:-1], (b, rank), (token, NEVER)]
                self.left[token] = [*self.left[a][:-1], (a, rank), (token, NEVER)]

    def _first_join(self, a: int, b: int) -> tuple[int, bool] | None:
        """The first merge across the border of two tokens side by side, and whether it joins both whole."""
        right, left = self.right[a], self.left[b]
        i = j = 0
        while True:
            piece, gone = right[i]
            other, lost = left[j]
            rank = self.rank.get((piece, other), NEVER)
            # Of equal merges the left one comes first, so the border yields to the left and wins to the right.
            if rank < gone and rank <= lost and rank < NEVER:
                return rank, i == len(right) - 1 and j == len(left) - 1
            if gone == lost == NEVER:
                return None
            if gone <= lost:
                i += 1
            else:
                j += 1

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether b may follow a, remembered for the pairs met so far."""
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        known = self.follows[a << 20 | b] = self._first_join(a, b) is None
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, each state of a shared prefix computed once."""
        ids, reach, follows, may_follow = self.ids.get, self.reach.get, self.follows.get, self._may_follow
        sizes = self.sizes
        encoded: dict[bytes, list[int]] = {}
        last: list[int] = [-1]  # last token of each prefix of the current path in the trie
        before = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                low = end - reach(word[end - 4 : end], 3) if end > 3 else 0
                for start in range(low if low > 0 else 0, end):
                    token = ids(word[start:end])
                    if token is None:
                        continue
                    if start:
                        good = follows(last[start] << 20 | token)
                        if good is None:
                            good = may_follow(last[start], token)
                        if not good:
                            continue
                    last.append(token)
                    break
                else:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
            found, at = [], len(word)
            while at:
                found.append(last[at])
                at -= sizes[last[at]]
            encoded[word] = found[::-1]
            before = word
        return encoded

    def _pieces(self, text: str) -> list[str]:
        """Parts that are encoded each by itself: single spaces begin one, unless more white space is around."""
        if self.split_special is not None and any(s in text for s in self.special):
            return [p for p in self.split_special.split(text) if p]
        if "\0" in text or self.wide.search(text):
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def add(self, pieces: set[str]) -> None:
        """Encode the pieces that the cache lacks: their distinct words, but for those met before, share one trie."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHED_PIECES:
            self.cache = {p: self.cache[p] for p in pieces if p in self.cache}
        split = {p: self.words.findall(p) for p in new if p not in self.special}
        known = self.words_kept
        words = {w for ws in split.values() for w in ws}
        if len(known) + len(words) > CACHED_WORDS:
            known = self.words_kept = {w: known[w] for w in words if w in known}
        spelled = {w: w.encode("utf-8", "replace") for w in words if w not in known}
        encoded = self.encode_words(list(set(spelled.values())))
        names = self.names
        for w, data in spelled.items():
            found = encoded[data]
            known[w] = "".join([names[i] for i in found]), len(found), self.decode(found)
        for piece in new:
            if piece not in split:
                own = self.special[piece]
                self.cache[piece] = names[own], 1, self.decode([own])
                continue
            own = [known[w] for w in split[piece]]
            if len(own) == 1:
                self.cache[piece] = own[0]
                continue
            texts, sizes, parts = zip(*own) if own else ((), (), ())
            self.cache[piece] = "".join(texts), sum(sizes), b"".join(parts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def __call__(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """Per text its pieces' ids as text, how many they are, and the bytes they decode to."""
        pieces = [self._pieces(t) for t in texts]
        self.add({p for ps in pieces for p in ps})
        return [[self.cache[p] for p in ps] for ps in pieces]


def encoded_and_decoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row the number of ids, their digest, and the digest of the text decoded from them."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_kept(("trie", path), lambda: TrieEncoder(path))
        for batch in blocks(batches):
            sizes, ids, texts = [], [], []
            for found in encoder(batch["text"].to_pylist()):
                sizes.append(sum(n for _, n, _ in found))
                ids.append(hashlib.sha256("".join([i for i, _, _ in found])[:-1].encode()).hexdigest())
                text = b"".join([b for _, _, b in found]).decode("utf-8", "replace")
                texts.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(
        coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
