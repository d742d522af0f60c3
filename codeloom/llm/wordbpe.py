"""Whole-batch encoding with a byte-level word BPE vocabulary (a ``tokenizers`` JSON file whose words end in a suffix).

White space separates words in such a vocabulary, so a text's ids are the concatenated ids of its words.  A batch is
split and made distinct inside Arrow, ids are found once for each distinct word, and numpy gathers them back:

* :class:`LibraryWords` asks the ``tokenizers`` library for the ids of words not seen yet;
* :class:`ForcedBoundaryWords` computes them here: byte pairs that occur inside no vocabulary token are certain cuts,
  the fragments between cuts are merged independently (all fragments of a batch at once) and concatenated.

Words are remembered in a table of bounded size.  Both give exactly the ids of
``Tokenizer.encode(text, add_special_tokens=False)`` for any text; null counts as empty.
"""

from __future__ import annotations

import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose normal form is their lower case: printable ASCII and the letters of Latin-1.
_SIMPLE = r"^[\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*$"
_TAIL = r"[a-z\x{df}-\x{f6}\x{f8}-\x{ff}][^a-z\x{df}-\x{f6}\x{f8}-\x{ff}0-9]+$"
_MARKS_AT_END = r"[^a-z\x{df}-\x{f6}\x{f8}-\x{ff}0-9]+$"
_TO_LAST_LETTER = r"^.*[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]"
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_ONE_PIECE = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"
_PLAIN = re.compile(rf"[\x21-\x7e{_LETTERS}]*\Z")

_REMEMBERED = 500_000
_LONGEST_REMEMBERED = 48
_SLICE_BYTES = 8_000_000


def gather(arena: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of ``arena[s : s + n]`` over all (s, n)."""
    ends = np.cumsum(lens, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return arena[:0]
    kind = np.int32 if max(total, len(arena)) < 2**31 - 1 else np.int64
    at = np.repeat((starts - (ends - lens)).astype(kind), lens)
    at += np.arange(total, dtype=kind)
    return arena[at]


def slices(col: pa.Array, most: int = _SLICE_BYTES):
    """(from, to) row ranges of about ``most`` bytes of text; a longer text stands alone."""
    lens = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lens.tolist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lens):
        yield start, len(lens)


class _Words:
    def __init__(self, path: str):
        # a worker is one of many; the library's threads would only keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.memo = pa.array([], pa.large_string())
        self.arena = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lens = np.zeros(1 << 16, np.int64)

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in any order, and where those of each word start and how many they are."""
        plain = pc.match_substring_regex(words, _ONE_PIECE).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._ids_of_plain(words)
        first, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        starts, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        ids, starts[first], counts[first] = self._ids_of_plain(words.take(pa.array(first)))
        more, counts[rest] = self._ids_of_any(words.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist())
        starts[rest] = len(ids) + np.cumsum(counts[rest]) - counts[rest]
        return np.concatenate([ids, more]), starts, counts

    def _ids_of_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of small letters only, which are one pre-token each."""
        raise NotImplementedError

    def _ids_of_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after the other, and how many each has."""
        raise NotImplementedError

    def _look_up(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """arena, starts and lens for distinct keys."""
        slot = pc.fill_null(pc.index_in(keys, value_set=self.memo), -1).to_numpy(zero_copy_only=False)
        starts, lens = self.starts[slot], self.lens[slot]
        missing = np.flatnonzero(slot < 0)
        if not len(missing):
            return self.arena[: self.used], starts, lens
        new, at, counts = self._ids_of(keys.take(pa.array(missing)))
        arena = np.concatenate([self.arena[: self.used], new])
        starts[missing], lens[missing] = self.used + at, counts
        short = pc.less_equal(pc.binary_length(keys), _LONGEST_REMEMBERED).to_numpy(zero_copy_only=False)
        keep = short[missing]
        if len(self.memo) + int(keep.sum()) <= _REMEMBERED:
            self._remember(keys.take(pa.array(missing[keep])), new, at[keep], counts[keep])
        else:
            # start again from the words of this slice, among them all frequent ones
            self._forget()
            keep = np.flatnonzero(short)[:_REMEMBERED]
            self._remember(keys.take(pa.array(keep)), arena, starts[keep], lens[keep])
        return arena, starts, lens

    def _remember(self, keys: pa.Array, new: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        ids, n, k = gather(new, starts, lens), len(self.memo), len(keys)
        for name, most in (("arena", self.used + len(ids)), ("starts", n + k), ("lens", n + k)):
            if most > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(most, old.dtype)]))
        self.arena[self.used : self.used + len(ids)] = ids
        self.starts[n : n + k] = self.used + np.cumsum(lens) - lens
        self.lens[n : n + k] = lens
        self.used += len(ids)
        self.memo = pa.concat_arrays([self.memo, keys.cast(pa.large_string())])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, and each text's offset (one more than texts)."""
        col = pc.fill_null(col, "").cast(pa.large_string())
        lists = pc.ascii_split_whitespace(col)
        bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if not len(words):
            return np.empty(0, np.uint32), np.zeros(len(col) + 1, np.int64)
        simple = pc.and_not(pc.match_substring_regex(words, _SIMPLE), pc.match_substring(words, "<|"))
        low = pc.if_else(simple, pc.utf8_lower(words), words)
        # where marks follow a letter, a pre-token ends: word and marks are looked up apart
        has = pc.and_(simple, pc.match_substring_regex(low, _TAIL)).to_numpy(zero_copy_only=False)
        tailed = low.filter(pa.array(has))
        whole = pc.replace_with_mask(low, pa.array(has), pc.replace_substring_regex(tailed, _MARKS_AT_END, ""))
        keys = pa.concat_arrays([whole, pc.replace_substring_regex(tailed, _TO_LAST_LETTER, "")]).dictionary_encode()
        arena, starts, lens = self._look_up(keys.dictionary)
        key = keys.indices.to_numpy(zero_copy_only=False)
        # ids of each distinct word: those of its first part, then of its marks
        marks = np.flatnonzero(has)
        order = np.concatenate([2 * np.arange(len(words)), 2 * marks + 1]).argsort(kind="stable")
        key = key[order]
        word_ids = gather(arena, starts[key], lens[key])
        word_n = lens[keys.indices.to_numpy(zero_copy_only=False)[: len(words)]].copy()
        word_n[marks] += lens[keys.indices.to_numpy(zero_copy_only=False)[len(words) :]]
        ids = gather(word_ids, (np.cumsum(word_n) - word_n)[at], word_n[at])
        done = np.concatenate([[0], np.cumsum(word_n[at])])
        return ids, done[bounds]

    def by_slice(self, col: pa.Array, most: int = _SLICE_BYTES, end_id: int | None = None):
        """(from, to, ids, offsets) of row ranges of about ``most`` bytes, so that memory is bounded by a slice or one text.

        ``end_id`` is put after each text's ids.
        """
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        for a, b in slices(col, most):
            ids, ends = self.encode(col[a:b])
            if end_id is not None:
                more = ends + np.arange(b - a + 1)
                out = np.full(len(ids) + b - a, end_id, np.uint32)
                body = np.ones(len(out), bool)
                body[more[1:] - 1] = False
                out[body] = ids
                ids, ends = out, more
            yield a, b, ids, ends

    def each(self, col: pa.Array):
        """(row, its ids) for every row, slice by slice."""
        for a, b, ids, ends in self.by_slice(col):
            for i in range(b - a):
                yield a + i, ids[ends[i] : ends[i + 1]]


class LibraryWords(_Words):
    """Distinct words are encoded by the ``tokenizers`` library."""

    def __init__(self, path: str):
        super().__init__(path)
        suffix = self.tok.model.end_of_word_suffix or ""
        self.ends_word = np.zeros(max(self.tok.get_vocab_size(), 1 + max(self.tok.get_vocab().values(), default=0)), bool)
        if suffix:
            self.ends_word[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True

    def _ids_of_plain(self, words):
        # one text of all words: each ends with the only token of it that has the suffix
        ids = np.array(self.tok.encode_batch_fast([" ".join(words.to_numpy(zero_copy_only=False).tolist())], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
            counts = np.diff(ends, prepend=0)
        else:
            ids, counts = self._ids_of_any(words.to_numpy(zero_copy_only=False).tolist())
            ends = np.cumsum(counts)
        return ids, ends - counts, counts

    def _ids_of_any(self, words):
        enc = self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.array(enc.word_ids, np.int64), minlength=len(words)) if len(enc.ids) else np.zeros(len(words), np.int64)
        return np.array(enc.ids, np.uint32), counts


class ForcedBoundaryWords(_Words):
    """Distinct words are cut at forced boundaries and merged here."""

    #: Fragments with more symbols are merged one by one with a heap, n log n in their length.
    _HEAP_FROM = 192

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.first = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in byte_characters()], np.int64)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        # where two bytes never stand side by side inside a token, no merge can join them
        self.joins = np.zeros((256, 256), bool)
        for t in vocab:
            body = [self.byte_of[c] for c in (t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t)]
            self.joins[body[:-1], body[1:]] = True
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = {int(k): r for r, k in enumerate(key)}
        super().__init__(path)

    def _pieces(self, word: str) -> list:
        """The word's pre-tokens as bytes; a special token as its id."""
        if "<|" not in word and _PLAIN.match(word):
            return [p.encode("utf-8") for p in _PIECES.findall(word)]
        out = []
        for part in self.at_special.split(word) if self.at_special else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.tok.normalizer.normalize_str(part)
                out += [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def _ids_of_plain(self, words):
        words = words.cast(pa.large_string())
        n = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        first = int(np.frombuffer(words.buffers()[1], np.int64)[words.offset])
        ids, frag_n, frag_owner = self._fragments(np.frombuffer(words.buffers()[2], np.uint8)[first : first + int(n.sum())], n)
        counts = np.bincount(frag_owner, weights=frag_n, minlength=len(n)).astype(np.int64)
        return ids.astype(np.uint32), np.cumsum(counts) - counts, counts

    def _fragments(self, raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces of n bytes each, one after the other: all ids; how many each fragment has; whose it is."""
        ends = np.cumsum(n)
        sym = self.first[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        cut = np.zeros(len(raw), bool)  # a fragment starts here
        cut[ends - n] = True
        cut[1:] |= ~self.joins[raw[:-1], raw[1:]]
        ids, frag_n = self._merge(sym, np.flatnonzero(cut))
        return ids, frag_n, np.repeat(np.arange(len(n)), n)[cut]

    def _ids_of_any(self, words):
        owner, pieces, specials = [], [], []
        for w, word in enumerate(words):
            for p in self._pieces(word):
                if isinstance(p, int):
                    specials.append((len(pieces), p))
                    p = b"!"
                owner.append(w)
                pieces.append(p)
        if not pieces:
            return np.empty(0, np.uint32), np.zeros(len(words), np.int64)
        ids, frag_n, frag_owner = self._fragments(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64))
        if specials:
            piece_at = np.concatenate([[0], np.cumsum(np.bincount(frag_owner, weights=frag_n, minlength=len(pieces)).astype(np.int64))])
            for i, special in specials:
                ids[piece_at[i]] = special
        counts = np.bincount(np.array(owner)[frag_owner], weights=frag_n, minlength=len(words)).astype(np.int64)
        return ids.astype(np.uint32), counts

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where(self.pair_key[at] == key, self.pair_rank[at], 1 << 40)

    def _merge(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges inside every fragment: in each round the lowest-ranked pair of each, the leftmost of equals."""
        n = np.diff(np.append(starts, len(sym)))
        out: list = [None] * 2
        frag = np.repeat(np.arange(len(n)), n)
        kept_sym, kept_frag = [], []
        long = n > self._HEAP_FROM
        for f in np.flatnonzero(long).tolist():
            got = self._merge_long(sym[starts[f] : starts[f] + n[f]].tolist())
            kept_sym.append(np.array(got, np.int64))
            kept_frag.append(np.full(len(got), f))
        if long.any():
            live = ~long[frag]
            sym, frag = sym[live], frag[live]
        while len(sym):
            rank = np.full(len(sym), 1 << 40)
            same = np.flatnonzero(frag[1:] == frag[:-1])
            rank[same] = self._ranks(sym[same], sym[same + 1])
            first = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            going = least < 1 << 40
            if not going.all():
                ended = np.repeat(~going, size)
                kept_sym.append(sym[ended])
                kept_frag.append(frag[ended])
            hit = np.flatnonzero((rank == np.repeat(least, size)) & np.repeat(going, size))
            if not len(hit):
                break
            hit = hit[np.concatenate([[True], frag[hit[1:]] != frag[hit[:-1]]])]
            sym[hit] = self.merged[rank[hit]]
            live = np.repeat(going, size)
            live[hit + 1] = False
            sym, frag = sym[live], frag[live]
        out_sym, out_frag = np.concatenate(kept_sym), np.concatenate(kept_frag)
        order = np.argsort(out_frag, kind="stable")
        return out_sym[order], np.bincount(out_frag, minlength=len(n))

    def _merge_long(self, sym: list[int]) -> list[int]:
        n = len(sym)
        right, left, size = [*range(1, n), -1], [-1, *range(n - 1)], self.size
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.rank_of.get(sym[i] * size + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.merged[r]), -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (q := self.rank_of.get(sym[i] * size + sym[k])) is not None:
                    heapq.heappush(heap, (q, i, sym[i], sym[k]))
            h = left[i]
            if h >= 0 and (q := self.rank_of.get(sym[h] * size + sym[i])) is not None:
                heapq.heappush(heap, (q, h, sym[h], sym[i]))
        return [s for s in sym if s >= 0]


class TokenStrings:
    """What ids stand for; all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = {**{i: t for t, i in spec["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in spec["added_tokens"]}}
        self.token = [known.get(i, "").encode("utf-8") for i in range(max(known) + 1)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of what a tokenizer without a decoder gives: the token strings with a space between."""
        return b" ".join(map(self.token.__getitem__, ids.tolist()))


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or 256 + a running number."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


_shared: dict[tuple[type, str], object] = {}


def shared(kind: type, path: str):
    """One encoder for each worker process."""
    if (kind, path) not in _shared:
        _shared[kind, path] = kind(path)
    return _shared[kind, path]
