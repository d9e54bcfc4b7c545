"""What the operators on documents share: the input columns, cached token ids, blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F


BLOCK_BYTES = 4 << 20  # text that a Python worker holds as Python objects at once
CACHED_PIECES = 600_000  # distinct pieces of text whose ids a task keeps
VISIBLE, LETTER, MARK, BLANK = 1, 2, 4, 8  # kinds of bytes
T = TypeVar("T")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_kept(key: tuple, make: Callable[[], T]) -> T:
    """The object of that key, made once in the life of a Python worker.

    This package reaches the workers by value, anew with every task, so its own globals
    don't last; a module that is only entered there does. For pure functions with bounded
    caches: a new worker has lost nothing but time.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_logtide_kept", types.ModuleType("_logtide_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text, a null text as the empty one. Other columns, whatever their names, are not read."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes, one row at least."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return letters


class TextEncoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian unsigned 32-bit integers.

    For byte-level vocabulary files. Texts are cut where no token reaches across (``_cuts``), and each
    distinct piece is encoded once as long as it is remembered: a run of Latin letters, which no normaliser
    changes and no pattern cuts, by the library's merge model alone, anything else by the whole tokenizer.
    Texts are cut, pieces told apart and ids put together in arrays; only distinct pieces of a block become
    Python objects. A text with a space between two pieces of white space, or with a special token in it,
    goes to the library whole.
    """

    def __init__(self, path: str, keeps_space: bool):
        """keeps_space: tokens begin with the space in front of a word, and letters keep their case;
        otherwise spaces are dropped and letters are lowered."""
        import os
        import re

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keeps_space = keeps_space
        self.wide = re.compile(r"\s (?!\S)")
        # Letters that both sides lower alike, then the runs that reach the merges as they are.
        self.latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
        self.plain = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+" if keeps_space else r"[a-zà-öø-ÿß]+")
        self.model = self.tokenizer.model
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.blank = self.letters[ord(" ")]
        kinds = np.zeros(256, np.uint8)
        kinds[0x21:0x7F] = VISIBLE
        kinds[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = VISIBLE | LETTER
        kinds[list(b".,;:!?#$%&*")] = VISIBLE | MARK
        kinds[[*range(9, 14), *range(0x1C, 0x21)]] = BLANK
        # Where the bytes of other white space begin and end.
        self.opens, self.closes = kinds.copy(), kinds.copy()
        self.opens[[0xC2, 0xE1, 0xE2, 0xE3]] |= BLANK
        self.closes[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] |= BLANK
        self.kinds = kinds
        self._forget()

    def _forget(self) -> None:
        """No piece is known; ``ids`` holds those of known ones one after the other, ``bounds`` where they begin."""
        import numpy as np

        self.cache: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, run: str) -> list[int]:
        if run.isascii():  # letters stand for themselves
            spelled = run.replace(" ", self.blank)
        else:
            spelled = run.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(spelled)]

    def _whole(self, text: str) -> bool:
        return any(s in text for s in self.special) or (self.keeps_space and self.wide.search(text) is not None)

    def _cuts(self, data, starts):
        """Where pieces begin in the bytes of texts that begin at ``starts``, and which texts may go whole.

        In front of spaces; between a letter and a mark behind it; and on both sides of a line
        end between two visible characters. Letters outside ASCII count where they are Latin ones of two bytes.
        """
        import numpy as np

        kinds = self.kinds[data]
        lead = data == 0xC3
        # Behind 0xC3 are the letters À to ÿ, but for the signs × and ÷.
        tail = np.zeros(len(data), bool)
        tail[1:] = lead[:-1]
        tail &= (data != 0x97) & (data != 0xB7)
        kinds[tail] = VISIBLE | LETTER
        space = data == 0x20
        cut = space.copy()
        cut[1:] |= (kinds[:-1] & LETTER != 0) & (kinds[1:] & MARK != 0)
        lines = np.flatnonzero(data == 0x0A)
        lines = lines[(lines > 0) & (lines < len(data) - 1)]
        lines = lines[(kinds[lines - 1] & VISIBLE != 0) & ((kinds[lines + 1] & VISIBLE != 0) | lead[lines + 1])]
        cut[lines] = True
        cut[lines + 1] = True
        cut[starts[starts < len(data)]] = True
        # Spaces with white space, or what may be its bytes, before them, and behind them that or the end.
        at = np.flatnonzero(space)
        at = at[at > 0]
        at = at[self.closes[data[at - 1]] & BLANK != 0]
        last = np.zeros(len(data) + 1, bool)
        last[starts] = True
        last[-1] = True
        behind = self.opens[data[np.minimum(at + 1, len(data) - 1)]] & BLANK != 0
        return np.flatnonzero(cut), at[behind | last[at + 1]]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces and remember them."""
        import numpy as np

        keeps, plain, latin, merged = self.keeps_space, self.plain.fullmatch, self.latin.fullmatch, self._merged
        flat: list[int] = []
        sizes, order = [], []
        rest = {}
        for piece in pieces:
            run = piece
            if not keeps:
                run = piece.removeprefix(" ")
                run = run.lower() if latin(run) else run
            if plain(run):
                found = merged(run)
                flat += found
                sizes.append(len(found))
                order.append(piece)
            else:
                rest[piece] = run
        for found in self._encoded(list(rest.values())):
            flat += found
            sizes.append(len(found))
        self._keep([*order, *rest], np.array(flat, np.uint32), np.array(sizes, np.int64))

    def _keep(self, pieces: list[str], flat, sizes) -> None:
        """Remember the ids of pieces, which are given one after the other."""
        import numpy as np

        first = len(self.cache)
        begin, end = int(self.bounds[first]), int(self.bounds[first]) + len(flat)
        while len(self.bounds) <= first + len(pieces):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while len(self.ids) < end:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[begin:end] = flat
        self.bounds[first + 1 : first + 1 + len(pieces)] = begin + np.cumsum(sizes)
        self.cache.update(zip(pieces, range(first, first + len(pieces))))

    def _places(self, pieces: list[str]):
        """Where the ids of each piece begin and how many they are, once those not known yet are encoded."""
        import numpy as np

        at = np.fromiter(map(self.cache.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [pieces[n] for n in missing.tolist()]
            if len(self.cache) + len(new) > CACHED_PIECES:
                stay = np.flatnonzero(at >= 0)
                begins = self.bounds[at[stay]]
                sizes = self.bounds[at[stay] + 1] - begins
                ids = _runs(self.ids, begins, sizes)
                self._forget()
                self._keep([pieces[n] for n in stay.tolist()], ids, sizes)
            self._learn(new)
            at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        begins = self.bounds[at]
        return begins, self.bounds[at + 1] - begins

    def arrays(self, texts: pa.Array):
        """The ids of all texts one after the other, and how many each text has."""
        import numpy as np

        count = len(texts)
        _, bounds, body = texts.buffers()
        if not count:
            return self.ids[:0], self.bounds[:0]
        bounds = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + count + 1].astype(np.int64)
        data = np.frombuffer(body or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cuts, doubtful = self._cuts(data, bounds[:-1])
        suspects = set((np.searchsorted(bounds, doubtful, "right") - 1).tolist()) if self.keeps_space else set()
        for special in self.special:
            suspects |= set(np.flatnonzero(pc.match_substring(texts, special)).tolist())
        whole = np.zeros(count, bool)
        whole[[n for n in suspects if self._whole(texts[n].as_py())]] = True
        in_whole = np.zeros(len(cuts), bool)
        if whole.any():
            text = np.searchsorted(bounds, cuts, "right") - 1
            stay = ~whole[text] | (cuts == bounds[text])
            cuts, in_whole = cuts[stay], whole[text[stay]]
        ends = pa.py_buffer(np.append(cuts, len(data)).astype(np.int32))
        pieces = pa.StringArray.from_buffers(len(cuts), ends, pa.py_buffer(np.ascontiguousarray(data)))
        found = pieces.dictionary_encode()
        codes, names = found.indices.to_numpy(), found.dictionary.to_pylist()
        ids = None
        if in_whole.any():  # these texts are not remembered
            apart = set(codes[in_whole].tolist())
            kept = [n for n in range(len(names)) if n not in apart]
            begins, sizes = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            begins[kept], sizes[kept] = self._places([names[n] for n in kept])
            used = int(self.bounds[len(self.cache)])
            own = self._encoded([names[n] for n in apart])
            sizes[list(apart)] = [len(i) for i in own]
            begins[list(apart)] = used + np.cumsum([0, *map(len, own)])[:-1]
            ids = np.concatenate([self.ids[:used], *(np.array(i, np.uint32) for i in own)])
        else:
            begins, sizes = self._places(names)
        sizes = sizes[codes]
        before = np.append(0, np.cumsum(sizes))
        per_text = np.diff(before[np.searchsorted(cuts, bounds)])
        return _runs(self.ids if ids is None else ids, begins[codes], sizes), per_text

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text."""
        import numpy as np

        ids, sizes = self.arrays(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _runs(values, begins, sizes):
    """The values from each of ``begins`` on, as many as ``sizes`` says, one after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begins - ends + sizes, sizes) + np.arange(total)]
