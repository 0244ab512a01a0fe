"""Exact tokenisation with vocabulary files, fast on repetitive corpora.

Two encoders, each giving exactly the ids (or counts) of its library:

* :class:`WordBpe` – a ``tokenizers`` JSON file whose pre-tokenizer cuts texts
  into words, so a text's ids are its words' ids in a row;
* :class:`PieceCounter` – a ``sentencepiece`` model whose pieces never hold a
  word mark after another character, so no merge crosses a space.

Both keep a bounded memory of words met before and hand the library only the
rest.  Texts outside the plain character set, or with a special token's string,
go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .blobs import mixed

#: Words that a worker's :class:`PieceCounter` remembers before its memory is emptied.
REMEMBERED = 700_000
#: Seats for words in the memory of :class:`WordBpe`, as a power of two; it is emptied after a third as many new words.
SEATS_LOG2 = 22
#: Words looked up at once: few enough for their columns to stay in the CPU's cache.
SLICE = 1 << 15

#: Letters that lower-case one to one and that Unicode composition leaves alone.
_PLAIN = re.compile("[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
#: The vocabulary file's word pattern, which :func:`_words` follows on plain lower-case text.
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOWER = bytes(ord(chr(i).lower()) if len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 256 else i for i in range(256))
#: Kind of a Latin-1 character: 0 white space, 1 letter, 2 digit, 3 other.
_KIND = np.array([0 if chr(i).isspace() else 2 if 48 <= i < 58 else 1 if chr(i).isalpha() else 3 for i in range(256)], np.uint8)
#: Keeps the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _words(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the words of plain lower-case Latin-1 text that ends in white space:
    runs of letters, single digits, runs of other marks, and the endings 's 't 're 've 'm 'll 'd."""
    kind = _KIND[chars]
    cut = np.ones(len(chars), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    mark = np.flatnonzero(chars == ord("'"))
    if len(mark):
        mark = mark[cut[mark]]
        a, b = chars[mark + 1], chars[np.minimum(mark + 2, len(chars) - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cut[mark[one | two] + 1] = False
        cut[mark[one] + 2] = True
        cut[mark[two] + 3] = True
    at = np.flatnonzero(cut)
    word = kind[at] != 0
    return at[word], np.diff(at, append=len(chars))[word]


def _with_room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, longer if it holds fewer than ``n`` numbers."""
    return a if len(a) >= n else np.concatenate((a, np.zeros(n, a.dtype)))


class WordBpe:
    """Ids of a ``tokenizers`` JSON file as little-endian unsigned 16-bit bytes
    (32-bit where the vocabulary has over 65,536 entries)."""

    def __init__(self, name: str, seats_log2: int = SEATS_LOG2):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = name if os.path.sep in name else vocabulary_path(name)
        self.library = Tokenizer.from_file(path)  # the measure of every id below
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        # The shortcut holds for this very scheme; any other file takes the library's way.
        self._cuts = (
            pre[0].get("pattern", {}).get("Regex") == _FILE_PATTERN
            and pre[0].get("behavior") == "Removed"
            and kinds == ["NFC", "Replace", "Lowercase"]
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )
        if self._cuts:  # the same model, held once, for texts already cut into words
            bare = {"model": spec["model"] | {"vocab": {}, "merges": []}, "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *pre[1:]]}}
            self._model = Tokenizer.from_str(json.dumps(spec | bare))
            self._model.model = self.library.model
            self._ends = np.zeros(self.library.get_vocab_size(), bool)
            self._ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        # The words met before are numbered from 1 as they come: both halves of a word of up to 16
        # bytes, zero at 0, and where each word's ids begin in the pool; the next word's end them.
        # The system gives memory to what is filled alone.
        seats = 1 << seats_log2
        room = seats // 3 + 2
        self._lo, self._hi, self._first = np.zeros(room, np.uint64), np.zeros(room, np.uint64), np.zeros(room, np.int32)
        self._pool, self._used, self._met = np.zeros(max(1 << 16, 2 * seats), self.dtype), 0, 0
        self._long: dict[bytes, int] = {}  # numbers of words of over 16 bytes
        # The others' numbers by seat, 0 in an empty one.  A seat is the word's that came last to
        # it; another that hashes there is learnt anew.
        self._shift = np.uint64(64 - seats_log2)
        self._seats = np.zeros(seats, np.int32)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: list[bytes]) -> range:
        """The numbers of ``new`` words from now on."""
        numbers = range(self._met + 1, self._met + 1 + len(new))
        self._lo, self._hi, self._first = (_with_room(a, numbers.stop + 1) for a in (self._lo, self._hi, self._first))
        for at in range(0, len(new), 256):
            part = new[at : at + 256]
            ids = np.array(self._model.encode(b" ".join(part).decode("latin-1"), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # a word whose last character the vocabulary lacks
                each = [np.frombuffer(self._whole(w.decode("latin-1")), self.dtype) for w in part]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            self._pool = _with_room(self._pool, self._used + len(ids))
            self._pool[self._used : self._used + len(ids)] = ids
            self._first[self._met + 2 : self._met + 2 + len(part)] = self._used + ends
            self._used += len(ids)
            self._met += len(part)
        return numbers

    def _look_up(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, count) in the pool of the ids of the words that lie at ``starts`` of ``raw``."""
        # A word of up to 16 bytes, none zero, is two numbers: read from the eights of bytes it lies in.
        eights, at, shift = np.frombuffer(raw, "<u8"), starts >> 3, ((starts & 7) << 3).astype(np.uint64)
        back, one = np.uint64(63) - shift, np.uint64(1)
        a, b, c = eights[at], eights[at + 1], eights[at + 2]
        lo = (a >> shift | b << one << back) & _FIRST[np.minimum(lengths, 8)]
        hi = (b >> shift | c << one << back) & _FIRST[np.clip(lengths - 8, 0, 8)]
        seat = (mixed(lo, hi) >> self._shift).astype(np.int64)
        word = self._seats[seat]
        miss = np.flatnonzero((self._lo[word] != lo) | (self._hi[word] != hi) | (lengths > 16))
        if len(miss):
            words = [raw[i:j] for i, j in zip(starts[miss].tolist(), (starts[miss] + lengths[miss]).tolist())]
            new = {w: i for w, i in zip(words, miss.tolist()) if w not in self._long}
            numbers = dict(zip(new, self._learn(list(new))))
            self._long.update((w, k) for w, k in numbers.items() if len(w) > 16)
            word[miss] = [numbers.get(w) or self._long[w] for w in words]
            short = np.array([i for w, i in new.items() if len(w) <= 16], int)
            self._lo[word[short]], self._hi[word[short]] = lo[short], hi[short]
            self._seats[seat[short]] = word[short]
        first = self._first[word]
        return first, self._first[word + 1] - first

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as bytes of :attr:`dtype`; a null text is empty."""
        if self._met > len(self._seats) // 3:
            self._seats.fill(0)
            self._long.clear()
            self._used = self._met = 0
        texts = [text or "" for text in texts]
        plain = [i for i, text in enumerate(texts) if self._cuts and _PLAIN.fullmatch(text) and not any(s in text for s in self._special)]
        out = [b""] * len(texts)
        for i in set(range(len(texts))).difference(plain):
            out[i] = self._whole(texts[i])
        if plain:  # one behind another, with a line's end after each
            joined = "\n".join([texts[i] for i in plain])
            raw = joined.encode("latin-1").translate(_LOWER) + b"\n" * (32 - len(joined) % 8)
            starts, lengths = _words(np.frombuffer(raw, np.uint8))
            ids, upto = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
            for at in range(0, len(starts), SLICE):
                first, count = self._look_up(raw, starts[at : at + SLICE], lengths[at : at + SLICE])
                ends = np.cumsum(count, dtype=np.int64)
                ids.append(self._pool[np.repeat(first - (ends - count), count) + np.arange(ends[-1])])
                upto.append(upto[-1][-1] + ends)
            ids, upto = np.concatenate(ids).tobytes(), np.concatenate(upto) * self.dtype.itemsize
            begin = np.cumsum([0] + [len(texts[i]) + 1 for i in plain])
            cut = upto[np.searchsorted(starts, begin)].tolist()
            for i, lo, hi in zip(plain, cut, cut[1:]):
                out[i] = ids[lo:hi]
        return out


class PieceCounter:
    """Token counts of a ``sentencepiece`` model, without begin and end marks."""

    def __init__(self, name: str):
        import sentencepiece

        path = name if os.path.sep in name else vocabulary_path(name)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.library
        pieces = [p.id_to_piece(i) for i in range(p.vocab_size())]
        # Spaces part words only if no piece has a word mark after another character,
        # and if the model keeps spaces as they are.
        self._cuts = not any(re.search("[^▁]▁", x) for x in pieces) and len(p.encode("a  b")) > len(p.encode("a b"))
        self._known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        """Each text's number of tokens; a null text is empty."""
        known, chunks = self._known, []
        for text in texts:
            text = text or ""
            if not self._cuts or not text or text[-1] == " " or "▁" in text or "\0" in text:
                chunks.append(text)
            elif "  " in text or text[0] == " ":
                chunks.append([c[1:] for c in re.findall(" +[^ ]*", " " + text)])
            else:
                chunks.append(text.split(" "))
        if len(known) > REMEMBERED:
            known.clear()
        new = list({c for cs in chunks if type(cs) is list for c in cs if c not in known})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            known.update(zip(part, map(len, self.library.encode(part, num_threads=1)), strict=True))
        get = known.__getitem__
        return [sum(map(get, cs)) if type(cs) is list else len(self.library.encode(cs)) for cs in chunks]


_LOADED: dict[tuple[type, str], object] = {}


def loaded(kind: type, name: str):
    """One encoder of each kind and file for each Python worker."""
    key = (kind, name)
    if key not in _LOADED:
        _LOADED[key] = kind(name)
    return _LOADED[key]
