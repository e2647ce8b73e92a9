"""Tokens of white-space separated words, each distinct word encoded once.

Both public vocabularies used here never form a token across white space, so a text's tokens
are its words' tokens in order. Texts repeat words a lot; a task keeps the words it has met
in a table of about ``limit`` words, which starts anew when full. Words differ by case and signs
more than the parts they are split into, so the parts of words are kept in a table of their own.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, compress, count, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from meterlight.llm.common import ranges

_READY: dict = {}


class Table:
    """Token ids of keys, which are numbered as they are met; ``nothing`` is 0 and has none."""

    def __init__(self, nothing: bytes | str):
        numbers = count()
        self.slots = defaultdict(numbers.__next__, {nothing: next(numbers)})
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.lengths = np.zeros(1, np.int64)

    def full(self, limit: int) -> bool:
        """Whether to start anew: many keys or, of long ones, many tokens, or encoding new keys failed."""
        return len(self.slots) > limit or len(self.ids) > 16 * limit or len(self.slots) != len(self.lengths)

    def find(self, keys: list, encode: Callable) -> np.ndarray:
        """Slots of the keys; ``encode`` gives ids and lengths of those not met before."""
        slots = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        new = list(islice(reversed(self.slots), len(self.slots) - len(self.lengths)))[::-1]
        if new:
            ids, lengths = encode(new)
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.starts = np.concatenate([self.starts, starts])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return slots

    def tokens(self, slots: np.ndarray) -> np.ndarray:
        """Ids of all ``slots`` in order."""
        return self.ids[ranges(self.starts[slots], self.lengths[slots])]


class WordEncoder:
    """Base: words to slots, slots to token ids."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.table = Table(b"")

    @property
    def lengths(self) -> np.ndarray:
        """Number of tokens of each slot."""
        return self.table.lengths

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` in order, and how many each has."""
        raise NotImplementedError

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Slot of every word of ``texts`` in order, and the number of words of each text."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        found = split.flatten().dictionary_encode()
        if self.table.full(self.limit):
            self.table = Table(b"")
        distinct = found.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)
        slots = self.table.find(distinct.tolist(), self.tokens)[found.indices.to_numpy()]
        # White space at the ends of a text gives empty words, which have slot 0.
        real = slots > 0
        sums = np.concatenate([[0], np.cumsum(real)])
        return slots[real], np.diff(sums[split.offsets.to_numpy()])

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Number of tokens of each text."""
        slots, counts = self.words(texts)
        sums = np.concatenate([[0], np.cumsum(self.lengths[slots])])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of tokens of each."""
        slots, counts = self.words(texts)
        sums = np.concatenate([[0], np.cumsum(self.lengths[slots])])
        ends = np.cumsum(counts)
        return self.table.tokens(slots), sums[ends] - sums[ends - counts]


# The splitting pattern of the vocabulary file, and the same pattern for words
# of printable ASCII and the Latin letters U+00C0 to U+017F only.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# "\n" ends a word; words with other characters, or that may hold a special token, are odd.
LATIN_PATTERN = r"[a-zß-öø-ſ]+|\n|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zß-öø-ſ0-9]+"
ODD_PATTERN = r"[^\n!-~À-ÖØ-öø-įıĲ-ſ]|<\|"


class JsonEncoder(WordEncoder):
    """A vocabulary of the ``tokenizers`` library whose pre-tokens hold no white space.

    Words of Latin letters need no normalising beyond lower case. If the file splits words by
    ``WORD_PATTERN``, they are split here, and the library encodes each distinct part without
    its slower normaliser and splitter. All other words go through the whole library.
    """

    TOGETHER, GROUPS = 256, 64

    def __init__(self, path: str, limit: int = 400_000, part_limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(Path(path).read_text())
        steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.parts, self.part_limit, self.part_table = None, part_limit, Table("\n")
        if steps[0].get("pattern") == {"Regex": WORD_PATTERN}:
            settings["normalizer"] = None
            steps[0] = {"type": "WhitespaceSplit"}
            self.parts = Tokenizer.from_str(json.dumps(settings))
            self.split = re.compile(LATIN_PATTERN).findall
            self.odd = re.compile(ODD_PATTERN).finditer
            # A pre-token's last token, and no other, has the suffix.
            suffix = settings["model"].get("end_of_word_suffix")
            vocab = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, first and end characters of each text's tokens."""
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            at = np.array(e.offsets, np.int64).reshape(-1, 2)
            out.append((np.array(e.ids, np.int64), at[:, 0], at[:, 1]))
        return out

    def joined(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, many encoded together with a space between them."""
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        ids, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        encoded = tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded):
            first = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            chars = np.fromiter(map(len, group), np.int64, len(group)) + 1
            place = np.searchsorted(np.cumsum(chars) - chars, first, side="right") - 1
            ids.append(np.array(e.ids, np.int64))
            lengths.append(np.bincount(place, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(lengths)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts; where the suffix does not tell them apart, the offsets do."""
        ids, lengths = [], []
        for i in range(0, len(parts), step := self.TOGETHER * self.GROUPS):
            own = parts[i : i + step]
            groups = [" ".join(own[k : k + self.TOGETHER]) for k in range(0, len(own), self.TOGETHER)]
            encoded = self.parts.encode_batch(groups, add_special_tokens=False)
            found = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int64)
            counts = np.diff(np.flatnonzero(self.last[found]), prepend=-1)
            if len(counts) != len(own):
                found, counts = self.joined(self.parts, own)
            ids.append(found)
            lengths.append(counts)
        return np.concatenate(ids), np.concatenate(lengths)

    def tokens(self, words):
        text = b"\n".join(words).decode("utf-8", "replace")
        decoded = text.split("\n")
        plain = np.full(len(words), self.parts is not None)
        if self.parts and (odd := [m.start() for m in self.odd(text)]):
            chars = np.fromiter(map(len, decoded), np.int64, len(words)) + 1
            plain[np.searchsorted(np.cumsum(chars), odd, side="right")] = False
            text = "\n".join(compress(decoded, plain))
        own_ids, own = self.plain_tokens(text) if plain.any() else (np.empty(0, np.int64),) * 2
        rest_ids, rest = self.joined(self.tokenizer, list(compress(decoded, ~plain)))
        lengths = np.empty(len(words), np.int64)
        lengths[plain] = own
        lengths[~plain] = rest
        ids = np.empty(int(lengths.sum()), np.int64)
        starts = np.cumsum(lengths) - lengths
        ids[ranges(starts[plain], own)] = own_ids
        ids[ranges(starts[~plain], rest)] = rest_ids
        return ids, lengths

    def plain_tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of Latin letters in ``text``, one a line, and how many each has."""
        if self.part_table.full(self.part_limit):
            self.part_table = Table("\n")
        slots = self.part_table.find(self.split(text.lower()), self.encode_parts)
        sums = np.concatenate([[0], np.cumsum(self.part_table.lengths[slots])])
        ends = np.append(np.flatnonzero(slots == 0), len(slots))
        return self.part_table.tokens(slots), np.diff(sums[ends], prepend=0)


class PieceEncoder(WordEncoder):
    """A ``sentencepiece`` vocabulary, applied to each word by itself."""

    def __init__(self, path: str, limit: int = 400_000):
        import sentencepiece

        super().__init__(limit)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array(
            [self.model.is_byte(i) for i in range(self.model.get_piece_size())], bool
        )

    def tokens(self, words):
        own = self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter(chain.from_iterable(own), np.int64, int(lengths.sum())), lengths


def encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file, made once in a worker, which holds one at a time."""
    if path not in _READY:
        _READY.clear()
        _READY[path] = (JsonEncoder if path.endswith(".json") else PieceEncoder)(path)
    return _READY[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
