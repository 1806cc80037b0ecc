"""Byte-pair encoding with word ends, vectorised over all new words of a batch, and tree
concatenation for long unsplit text.  Arrow cuts the texts at white space and numbers their
different chunks, so a batch looks each of them up once.

A text is split at white space, then into words by the vocabulary's pattern; no merge
crosses a word.  Words seen before come from a cache of bounded bytes that never takes up a
long one.  New words are merged together: every round applies each word's lowest-ranked pair, leftmost first, to all
words at once.

A word longer than ``LEAF`` symbols (text without white space, digits or a change between
letters and marks) is cut in halves down to leaves, which are all encoded side by side.
Two halves are joined by encoding a window of ``k`` tokens on each side of the cut, with
``k`` doubled until the window begins with the left half's own token and ends with the
right half's own token, or covers both.  A sequence of tokens is the encoding of its text
exactly if every adjacent pair is the encoding of its own two tokens' text; after the
agreement every pair of the joined sequence is adjacent in one of three encodings, so the
result equals that of the whole word.
"""

from __future__ import annotations

import heapq
import json
import sys
import types
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Symbols (bytes) up to which a word is encoded at once.
LEAF = 64
#: Bytes of words and chunks, with their ids, that a worker keeps before it forgets them all, what an
#: entry takes besides, and the characters beyond which one is never kept.
CACHE_BYTES = 250_000_000
ENTRY_BYTES = 250
KEPT_CHARS = 256

# The white space and the split pattern that the vocabulary file states.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
#: Separators that Python's split() takes for white space and the vocabulary does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"

#: The first code point without a meaning; below it all tables agree.
FIRST_UNASSIGNED = "\u0378"

NONE = np.int64(1 << 40)

#: Kinds of characters; each one of the last two is a word of its own.
LETTER, OTHER, DIGIT, LINE_END = range(4)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def worker_encoder(file: str) -> WordBpe:
    """The encoder of ``file``, kept with its cache for the next task of this worker process."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    mark = hash(file)
    if getattr(kept, "mark", None) != mark:
        kept.mark, kept.encoder = mark, WordBpe(file)
    return kept.encoder


def forget_encoder() -> None:
    """Let go of the encoder that this worker process keeps, if any: for tasks of other steps."""
    sys.modules.pop("_kept_encoders", None)


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]


class IdTable:
    """Strings, numbered in the order they came, with the ids of all of them in one growing array."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.empty(1 << 12, np.uint32)
        self.bounds = np.zeros(1 << 10, np.int64)

    def __len__(self) -> int:
        return len(self.number)

    def items(self) -> Iterator[tuple[str, bytes]]:
        for text, n in self.number.items():
            yield text, self.flat[self.bounds[n] : self.bounds[n + 1]].tobytes()

    def add(self, texts: Sequence[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Put new strings in, with their ids in a row."""
        n = len(self.number)
        used = int(self.bounds[n])
        if len(self.flat) < used + len(ids):
            self.flat = np.concatenate([self.flat[:used], np.empty(used + 2 * len(ids), np.uint32)])
        if len(self.bounds) <= n + len(texts):
            self.bounds = np.concatenate([self.bounds[: n + 1], np.empty(n + 2 * len(texts), np.int64)])
        self.flat[used : used + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(texts)] = used + np.cumsum(lengths)
        self.number.update(zip(texts, range(n, n + len(texts))))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings with these numbers in a row, and how many each has."""
        starts = self.bounds[numbers]
        lengths = self.bounds[numbers + 1] - starts
        return spread(self.flat, starts, lengths), lengths


class WordBpe:
    """Encoder for a vocabulary file of the ``tokenizers`` library of the word-end kind."""

    def __init__(self, file: str):
        import regex

        self.file, self.library = file, None
        spec = json.loads(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._index(left << 20 | right)
        self.words = regex.compile(WORDS)
        self.letter, self.digit = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
        self.kind, self.kinds_of = np.zeros(sys.maxunicode + 1, np.uint8), set()
        self.words_and_ends = regex.compile(WORDS + r"|\n")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.of_word, self.of_chunk = IdTable(), IdTable()
        self.held = 0

    # pairs of tokens -> rank, by an open-addressed table

    def _index(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        ranks = np.arange(len(keys))
        at = self._place(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] < 0
            self.keys[at[free][::-1]] = keys[free][::-1]  # of those that meet, the first stays
            won = self.keys[at] == keys
            self.ranks[at[won][::-1]] = ranks[won][::-1]
            keys, ranks, at = keys[~won], ranks[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        at = self._place(keys)
        held = self.keys[at]
        same = held == keys
        found = np.where(same, self.ranks[at], NONE)
        open_ = np.flatnonzero(~same & (held != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            slot = (at[open_] + step) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            same = held == keys[open_]
            found[open_[same]] = self.ranks[slot[same]]
            open_ = open_[~same & (held != -1)]
        return found

    # merging

    def symbols(self, data: bytes, final: bool) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        ids = self.inner[raw]
        if final and len(ids):
            ids[-1] = self.last[raw[-1]]
        return ids

    def merge_all(self, words: Sequence[tuple[bytes, bool]]) -> list[np.ndarray]:
        """Token ids of each word; the flag says whether the word's end is in it."""
        done: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        short = []
        for i, (data, final) in enumerate(words):
            if len(data) > 4 * LEAF:
                done[i] = self._merge_one(self.symbols(data, final))
            elif data:
                short.append(i)
            else:
                done[i] = np.empty(0, np.int64)
        if short:
            flat, bounds = self._merge_side_by_side(
                [words[i][0] for i in short], np.array([words[i][1] for i in short])
            )
            for i, a, b in zip(short, bounds.tolist(), bounds[1:].tolist()):
                done[i] = flat[a:b]
        return done

    def _merge_side_by_side(self, words: Sequence[bytes], final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and the bounds of each word's own.  ``final``: the word's end is in it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        ids[ends[final]] = self.last[raw[ends[final]]]
        word = np.repeat(np.arange(len(words)), sizes)
        result_ids, result_words = [], []

        def ranks_at(i: np.ndarray) -> np.ndarray:
            nxt = np.minimum(i + 1, len(ids) - 1)
            return np.where((i + 1 < len(ids)) & (word[i] == word[nxt]), self.rank(ids[i], ids[nxt]), NONE)

        ranks = ranks_at(np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.r_[starts, len(ids)])
            over = np.repeat(best == NONE, lengths)
            if over.any():
                result_ids.append(ids[over])
                result_words.append(word[over])
                ids, word, ranks = ids[~over], word[~over], ranks[~over]
                if not len(ids):
                    break
                lengths, best = lengths[best != NONE], best[best != NONE]
            hits = np.flatnonzero(ranks == np.repeat(best, lengths))
            first = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]  # leftmost of each word
            ids[first] = self.merged[best]
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            place = np.cumsum(keep) - 1
            ids, word, ranks = ids[keep], word[keep], ranks[keep]
            at = place[first]
            ranks[at] = ranks_at(at)
            before = at - 1
            before = before[before >= 0]
            ranks[before] = ranks_at(before)
        all_words = np.concatenate(result_words)
        order = np.argsort(all_words, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(all_words, minlength=len(words)))]
        return np.concatenate(result_ids)[order], bounds

    def _merge_one(self, ids: np.ndarray) -> np.ndarray:
        """One long run of symbols, by a queue of pairs."""
        tokens = ids.tolist()
        n = len(tokens)
        ranks = self.rank(ids[:-1], ids[1:])
        queue = [(r, i, a, b) for i, (r, a, b) in enumerate(zip(ranks.tolist(), tokens, tokens[1:])) if r != NONE]
        heapq.heapify(queue)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = tokens[i], tokens[j]
            if pair not in known:
                known[pair] = int(self.rank(np.array(pair[:1]), np.array(pair[1:]))[0])
            if known[pair] != NONE:
                heapq.heappush(queue, (known[pair], i, *pair))

        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([t for t in tokens if t >= 0], np.int64)

    # tree concatenation

    def sizes_of(self, ids: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            # word-end symbols add no byte
            end = len(self.tokens[self.last[0]]) - 1
            lengths = [len(t) - (end if t.endswith(self.tokens[self.last[0]][1:]) and len(t) > end else 0) for t in self.tokens]
            self._sizes = np.array(lengths, np.int64)
        return self._sizes[ids]

    def tree(self, data: bytes, leaf: int = LEAF) -> np.ndarray:
        """Token ids of one whole word, from halves."""
        count = 1
        while len(data) / count > leaf:
            count *= 2
        cuts = [len(data) * i // count for i in range(count + 1)]
        parts = self.merge_all([(data[a:b], b == len(data)) for a, b in zip(cuts, cuts[1:])])
        while len(parts) > 1:
            cuts = cuts[::2]
            parts = self._join_level(data, cuts, parts)
        return parts[0]

    def _join_level(self, data: bytes, cuts: list[int], parts: list[np.ndarray]) -> list[np.ndarray]:
        """Join parts 0 and 1, 2 and 3, ...; ``cuts`` bound the joined parts."""
        pairs = list(zip(parts[::2], parts[1::2]))
        ends = [np.cumsum(self.sizes_of(left)) + a for (left, _), a in zip(pairs, cuts)]
        middles = [int(e[-1]) if len(e) else a for e, a in zip(ends, cuts)]
        right_ends = [np.cumsum(self.sizes_of(right)) + m for (_, right), m in zip(pairs, middles)]
        joined: list[np.ndarray] = [None] * len(pairs)  # type: ignore[list-item]
        open_, k = list(range(len(pairs))), 2
        while open_:
            windows = []
            for p in open_:
                left, right = pairs[p]
                i, j = max(0, len(left) - k), min(len(right), k)
                begin = int(ends[p][i - 1]) if i else cuts[p]
                stop = int(right_ends[p][j - 1]) if j else middles[p]
                windows.append((i, j, data[begin:stop], stop == len(data)))
            still = []
            for p, (i, j, _, _), ids in zip(open_, windows, self.merge_all([(d, f) for _, _, d, f in windows])):
                left, right = pairs[p]
                agree_left = i == 0 or (len(ids) and ids[0] == left[i])
                agree_right = j == len(right) or (len(ids) and ids[-1] == right[j - 1])
                if agree_left and agree_right:
                    joined[p] = np.concatenate([left[:i], ids, right[j:]])
                else:
                    still.append(p)
            open_, k = still, 2 * k
        return joined

    # words, chunks, texts

    def _normal(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        chunk = unicodedata.normalize("NFC", chunk)
        # character by character: a final sigma is no special case
        return "".join([c.lower() for c in chunk]) if "Σ" in chunk else chunk.lower()

    def _by_library(self, chunk: str) -> list[int]:
        """For characters that this Python's Unicode tables do not know: the library has its own."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file)
        return self.library.encode(chunk, add_special_tokens=False).ids

    def _parts(self, chunk: str, normal: str) -> list[str | int]:
        """The words of a chunk, and the numbers of special strings in it."""
        if not (self.special and "<" in chunk and (found := list(self.special.finditer(chunk)))):
            return self.words.findall(normal)
        parts: list[str | int] = []
        at = 0
        for m in found:
            parts += [*self.words.findall(self._normal(chunk[at : m.start()])), self.specials[m[0]]]
            at = m.end()
        return parts + self.words.findall(self._normal(chunk[at:]))

    def _odd(self, chunks: list[str]) -> tuple[set[str], set[str]]:
        """Chunks that are taken one by one (long, with special strings or a capital sigma), and those among
        them for the library."""
        used = set("".join(chunks))
        unknown = {c for c in used if c >= FIRST_UNASSIGNED and unicodedata.category(c) == "Cn"}
        foreign = {c for c in chunks if not unknown.isdisjoint(c)} if unknown else set()
        odd = {c for c in chunks if len(c) > KEPT_CHARS}
        if "<" in used and self.special:
            odd.update([c for c in chunks if "<" in c])
        if "Σ" in used:
            odd.update([c for c in chunks if "Σ" in c])
        return odd | foreign, foreign

    def _learn(self, chunks: list[str]) -> dict[str, np.ndarray]:
        """Put ``chunks`` into the cache; the ids of those that it does not keep are returned."""
        odd, foreign = self._odd(chunks)
        passing: dict[str, np.ndarray] = {}
        for chunk in odd:
            if chunk in foreign:
                passing[chunk] = np.array(self._by_library(chunk), np.uint32)
                continue
            ids = self._encode_parts(self._parts(chunk, self._normal(chunk)))
            if len(chunk) > KEPT_CHARS:
                passing[chunk] = ids
            else:
                self._keep(self.of_chunk, [chunk], ids, np.array([len(ids)]))
        plain = [c for c in chunks if c not in odd] if odd else chunks
        for group in ([c for c in plain if "'" not in c], [c for c in plain if "'" in c]):
            if group:
                self._learn_plain(group)
        return passing

    def _cut(self, lines: str) -> pa.Array:
        """The words and line ends of a text without other white space."""
        if "'" in lines:
            return pa.array(self.words_and_ends.findall(lines), pa.large_string())
        # without a short form such as 's, a word ends where the kind of character changes and after each digit
        for c in set(lines) - self.kinds_of:
            self.kind[ord(c)] = self.kind_of(c)
            self.kinds_of.add(c)
        points = np.frombuffer(lines.encode("utf-32-le"), "<u4")
        kind = self.kind[points]
        starts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] >= DIGIT)])
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        upto = np.r_[0, np.cumsum(width)]
        offsets = upto[np.r_[starts, len(points)]]
        return pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(offsets), pa.py_buffer(lines.encode())
        )

    def kind_of(self, c: str) -> int:
        return LINE_END if c == "\n" else LETTER if self.letter.match(c) else DIGIT if self.digit.match(c) else OTHER

    def _learn_plain(self, chunks: list[str]) -> None:
        """All chunks are normalised and cut into words as one text, a line for each."""
        lines = "\n".join(chunks)
        if not lines.isascii():
            lines = unicodedata.normalize("NFC", lines)
        parts = self._cut(lines.lower() + "\n").dictionary_encode()
        part, words = parts.indices.to_numpy(), parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        end = words.index("\n")
        known = self.of_word.number
        number = list(map(known.get, words))
        if fresh := [w for w, n in zip(words, number) if n is None and w != "\n"]:
            self._keep(self.of_word, *self._encode_words(fresh))
        number = np.array([known.get(w, 0) if n is None else n for w, n in zip(words, number)])
        is_end = part == end
        ids, lengths = self.of_word.gather(number[part[~is_end]])
        upto = np.r_[0, np.cumsum(lengths)]
        ends = np.flatnonzero(is_end)
        after = upto[ends - np.arange(len(ends))]  # ids before the end of each chunk
        self._keep(self.of_chunk, chunks, ids, np.diff(np.r_[0, after]))

    def _keep(self, table: IdTable, texts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        table.add(texts, ids, lengths)
        self.held += ENTRY_BYTES * len(texts) + 4 * len(ids) + sum(map(len, texts))

    def _encode_parts(self, parts: list[str | int]) -> np.ndarray:
        """The ids of words, which no cache keeps, and of special strings."""
        table = IdTable()
        if words := list({w for w in parts if isinstance(w, str)}):
            table.add(*self._encode_words(words))
        known = [table.gather(np.array([table.number[w]]))[0] if isinstance(w, str) else [w] for w in parts]
        return np.concatenate(known).astype(np.uint32) if known else np.empty(0, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, their ids in a row, and how many each has."""
        data = [w.encode() for w in words]
        short = [i for i, d in enumerate(data) if len(d) <= LEAF]
        order, ids, lengths = [words[i] for i in short], [], []
        if short:
            flat, bounds = self._merge_side_by_side([data[i] for i in short], np.ones(len(short), bool))
            ids.append(flat)
            lengths.append(np.diff(bounds))
        if len(short) < len(words):
            for word, d in zip(words, data):
                if len(d) > LEAF:
                    order.append(word)
                    ids.append(self.tree(d))
                    lengths.append(np.array([len(ids[-1])]))
        return order, np.concatenate(ids).astype(np.uint32), np.concatenate(lengths)

    def _chunks(self, texts: Sequence[str]) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts in a row, and the bounds of each text's own."""
        if any(c in text for text in texts for c in NOT_SPACE):
            lists = [[c for c in self.spaces.split(text) if c] for text in texts]
            cut = pa.array(lists, pa.large_list(pa.large_string()))
        else:
            cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        flat = cut.flatten()
        filled = pc.greater(pc.binary_length(flat), 0)
        upto = np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))]
        sizes = pc.list_value_length(cut).to_numpy()
        return flat.filter(filled), upto[np.r_[0, np.cumsum(sizes)]]

    def encode_batch(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.of_chunk.clear()
            self.of_word.clear()
            self.held = 0
        if not texts:
            return
        flat, bounds = self._chunks(texts)
        numbered = flat.dictionary_encode()
        ids, lengths = self._ids_of(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        chunk = numbered.indices.to_numpy()
        size = lengths[chunk]
        made = spread(ids, (np.cumsum(lengths) - lengths)[chunk], size).astype("<u4").tobytes()
        upto = 4 * np.r_[0, np.cumsum(size)][bounds]
        for a, b in zip(upto.tolist(), upto[1:].tolist()):
            yield made[a:b]

    def _ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks in a row, and how many each has."""
        known = self.of_chunk.number
        number = list(map(known.get, chunks))
        missing = [c for c, n in zip(chunks, number) if n is None]
        passing = self._learn(missing) if missing else {}
        if not passing:
            return self.of_chunk.gather(np.array([known[c] if n is None else n for c, n in zip(chunks, number)], np.int64))
        kept = [c for c in chunks if c not in passing]
        ids, lengths = self.of_chunk.gather(np.fromiter(map(known.__getitem__, kept), np.int64, len(kept)))
        sizes = np.fromiter((len(passing[c]) if c in passing else -1 for c in chunks), np.int64, len(chunks))
        own = sizes >= 0
        sizes[~own] = lengths
        starts = np.empty(len(chunks), np.int64)
        starts[~own] = np.cumsum(lengths) - lengths
        starts[own] = len(ids) + np.cumsum(sizes[own]) - sizes[own]
        both = np.concatenate([ids, *[passing[c] for c in chunks if c in passing]])
        return spread(both, starts, sizes), sizes

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens as the file spells them, word ends included, joined by spaces: it names no decoder."""
        return " ".join([self.tokens[i] for i in ids])
