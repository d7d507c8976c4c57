"""BPE encoding of whole texts, by chunks that are encoded once, and by a tree of halves joined exactly."""

import os
import re
from array import array

import numpy as np

_DOUBLE = re.compile(r" (?<=\s )")
#: One pre-token: letters (the Latin blocks hold no others here), with the space before them.
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
_loaded = {}


def load(path: str, keep: int = 1_000_000):
    """The encoder of a tokenizer file that keeps so many chunks, one for each Python worker."""
    if (path, keep) not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path, keep] = Encoder(path, keep)
    return _loaded[path, keep]


def _byte_letters() -> dict:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, with add_special_tokens=False.

    Texts are cut where a space follows a character that is no space. No match of the byte-level pattern crosses such
    a place and none looks back, so each chunk has the same ids in every text; a chunk is encoded by the library when
    it is first met and kept (at most `keep` chunks, of more those of the texts at hand; the last used ones stay). Added
    tokens are cut out first. Tokenizers of another kind are called with whole texts.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.cache, self.old, self.tails = Tokenizer.from_file(path), keep, {}, {}, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = type(self.tokenizer.pre_tokenizer).__name__
        added = list(self.tokenizer.get_added_tokens_decoder().items())
        plain = all(not (t.normalized or t.lstrip or t.rstrip or t.single_word) for _, t in added)
        self.byte_level = pre == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.chunked = self.byte_level and plain
        self.added = {t.content: i for i, t in added}
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        size = self.tokenizer.get_vocab_size()
        self.code, self.dtype = ("H", np.uint16) if size <= 1 << 16 else ("I", np.uint32)
        self._lengths = None
        self.model, self.letters = self.tokenizer.model, {b: c for c, b in _byte_letters().items()}
        self.space = self.letters[32]
        if self.chunked:
            self.model._resize_cache(0)  # chunks are kept here

    def _ids(self, chunks: list) -> list:
        """Ids of chunks as bytes. A word is one pre-token and goes to the library's model, all else to its encoder."""
        out, rest, places = [b""] * len(chunks), [], []
        tokenize, code = self.model.tokenize, self.code
        for k, c in enumerate(chunks):
            if not _WORD.fullmatch(c):
                rest.append(c)
                places.append(k)
                continue
            raw = c.replace(" ", self.space) if c.isascii() else c.encode().decode("latin-1").translate(self.letters)
            out[k] = array(code, [t.id for t in tokenize(raw)]).tobytes()
        for i in range(0, len(rest), 20_000):
            for k, e in zip(places[i : i + 20_000], self.tokenizer.encode_batch_fast(rest[i : i + 20_000], add_special_tokens=False)):
                out[k] = array(code, e.ids).tobytes()
        return out

    def _words(self, words: list) -> list:
        """Ids as bytes of chunks that are given without the space they start with. The signs after a word are pre-tokens
        of their own, so words are kept without them."""
        stems, signed = [w.rstrip(_PUNCTUATION) for w in words], []
        for i, (word, stem) in enumerate(zip(words, stems)):
            if word is not stem and word != stem:
                if len(word) - len(stem) < 9 and (stem.isascii() and stem.isalpha() or _WORD.fullmatch(stem)):
                    signed.append(i)
                else:
                    stems[i] = word
        ids = self._kept(stems)
        for i in signed:
            tail = words[i][len(stems[i]) :]
            if tail not in self.tails:
                self.tails[tail] = array(self.code, self.tokenizer.encode(tail, add_special_tokens=False).ids).tobytes()
            ids[i] += self.tails[tail]
        return ids

    def _kept(self, stems: list) -> list:
        """Ids of stems after a space, from those that are kept. When these grow too many, the ones that were not needed
        since the last time go."""
        ids = list(map(self.cache.get, stems))
        new = {stems[i] for i, x in enumerate(ids) if x is None}
        if new and len(self.cache) + len(new) > self.keep // 2:
            self.old, self.cache = self.cache, {c: x for c, x in zip(stems, ids) if x is not None}
            for c in self.cache:
                del self.old[c]
        again = self.old.keys() & new
        self.cache.update((c, self.old.pop(c)) for c in again)
        new = list(new.difference(again))
        self.cache.update(zip(new, self._ids([" " + c for c in new])))
        if len(self.cache) + len(self.old) > self.keep:
            self.old = {}
        return [self.cache[c] if x is None else x for c, x in zip(stems, ids)]

    def _cut(self, text: str) -> list:
        """(chunk without or None, chunks whose leading space is left out) in turn."""
        if self.special is not None and self.special.search(text):
            return [x for i, p in enumerate(self.special.split(text)) for x in ([(p, ())] if i % 2 else self._cut(p))]
        if _DOUBLE.search(text):
            return [(None, (c[1:],)) if c[:1] == " " else (c, ()) for c in _SAFE.split(text)]
        head, *rest = text.split(" ")
        return [(head, rest)]

    def encode(self, texts: list) -> list:
        """Id arrays of whole texts; a null text is empty."""
        texts = ["" if t is None else t for t in texts]
        if not self.chunked:
            return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parted = [bool(_DOUBLE.search(t) or self.special is not None and self.special.search(t)) for t in texts]
        whole = iter(self._plain([t for t, p in zip(texts, parted) if not p]))
        cut = iter(self._parts([t for t, p in zip(texts, parted) if p]))
        return [next(cut if p else whole) for p in parted]

    def _parts(self, texts: list) -> list:
        cut = [self._cut(t) for t in texts]
        rest = list({c for parts in cut for _, rest in parts for c in rest})
        heads = list({head for parts in cut for head, _ in parts if head})
        spaced, first = dict(zip(rest, self._words(rest))), dict(zip(heads, self._ids(heads)))
        first[None] = first[""] = b""
        get = spaced.__getitem__
        return [np.frombuffer(b"".join([x for head, rest in parts for x in (first[head], *map(get, rest))]), dtype=self.dtype) for parts in cut]

    def _plain(self, texts: list) -> list:
        """Texts that are cut at every space: their chunks are told apart as a column, and their ids put together so."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        chunks = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy().astype(np.int64)
        # The first chunk of a text has no space before it.
        head = np.zeros(len(at), dtype=bool)
        head[first[:-1]] = True
        used = np.flatnonzero(np.bincount(at[~head], minlength=len(words)))
        heads, place = np.unique(at[head], return_inverse=True)
        ids = self._words(words[used].tolist()) + self._ids(words[heads].tolist())
        rank = np.zeros(len(words), dtype=np.int64)
        rank[used] = np.arange(len(used))
        at = rank[at]
        at[head] = len(used) + place
        flat = np.frombuffer(b"".join(ids), dtype=self.dtype)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype().itemsize
        start, n = np.cumsum(size) - size, size[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = flat[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])]
        return [flat[a:b] for a, b in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist())]

    def _tables(self):
        if self._lengths is None:
            letters = _byte_letters()
            size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
            raw = [b""] * size
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                known = all(c in letters for c in token)
                raw[i] = bytes(letters[c] for c in token) if known else token.encode()
            self._lengths = np.array([len(r) for r in raw], dtype=np.int64)
            self._starts = np.concatenate(([0], np.cumsum(self._lengths)[:-1]))
            self._flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        return self._lengths

    def lengths(self, ids):
        """Bytes of each token of a byte-level vocabulary."""
        return self._tables()[ids]

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        if not self.byte_level:
            return self.tokenizer.decode(list(map(int, ids)), skip_special_tokens=False)
        self._tables()
        n = self._lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self._starts[ids] - (ends - n), n)
        return self._flat[at].tobytes().decode("utf-8", "replace")


def _kind(c: str) -> str:
    import unicodedata

    if c.isspace():
        return "S"
    return {"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "P")


def _breaks(a: int, b: int) -> bool:
    """Whether a pre-token always ends between ASCII bytes a and b, whatever stands around them."""
    if a > 127 or b > 127 or a < 33:
        return False
    if b in (32, 9, 10, 13):
        return a > 32
    la, lb = _ASCII[a], _ASCII[b]
    return la != lb and lb != "S" and la != "S" and not (la == "P" and lb == "L") and a != 127 and b > 32


_ASCII = ["S" if i <= 32 else "N" if 48 <= i <= 57 else "L" if chr(i).isalpha() else "P" for i in range(128)]


class TreeEncoder:
    """Tree concatenation: halves of a long unsplit text are encoded apart and joined exactly.

    A text of more than `leaf` bytes is halved until its leaves are short; all leaves of a batch are encoded in one
    call. Halves are then joined level by level: the tokens around the join are encoded anew in a window that grows
    until both sides agree. A side agrees at a place where a pre-token ends whatever stands around it, or, inside one
    long pre-token, when the window's outermost token is the side's own token at that place: a sequence of BPE tokens
    is the encoding if every two neighbours are, so it may be cut and joined there. At last the window is the whole.
    """

    def __init__(self, encoder: Encoder, leaf: int = 4096):
        self.encoder, self.leaf = encoder, leaf
        self.windows = 0

    def encode(self, texts: list) -> list:
        enc = self.encoder
        if not enc.byte_level:
            return enc.encode(texts)
        pieces, owner = [], []
        for k, t in enumerate(texts):
            parts = enc.special.split(t or "") if enc.special is not None else [t or ""]
            for i, p in enumerate(parts):
                if p:
                    pieces.append(enc.added[p] if i % 2 else p.encode())
                    owner.append(k)
        done = self._trees(pieces)
        rows = [[] for _ in texts]
        for k, ids in zip(owner, done):
            rows[k].append(ids)
        return [np.concatenate(r) if r else np.empty(0, dtype=enc.dtype) for r in rows]

    def _trees(self, pieces: list) -> list:
        enc, leaves, trees = self.encoder, [], []
        for p in pieces:
            if isinstance(p, int):
                trees.append(None)
                continue
            cuts = self._halve(p, 0, len(p))
            trees.append((len(leaves), len(leaves) + len(cuts) - 1))
            leaves += [(p, a, b) for a, b in zip(cuts[:-1], cuts[1:])] if len(cuts) > 1 else []
        ids = enc.encode([p[a:b].decode() for p, a, b in leaves])
        # A node: piece, start, end, ids. Levels join neighbours of the same piece two by two.
        rows = [[(p, a, b, ids[i]) for i, (p, a, b) in enumerate(leaves[t[0] : t[1]], t[0])] if t else None for t in trees]
        while any(r and len(r) > 1 for r in rows):
            pairs = [(k, j) for k, r in enumerate(rows) if r and len(r) > 1 for j in range(0, len(r) - 1, 2)]
            joined = self._join([(rows[k][j], rows[k][j + 1]) for k, j in pairs])
            new = {}
            for (k, _), node in zip(pairs, joined):
                new.setdefault(k, []).append(node)
            for k, nodes in new.items():
                rows[k] = nodes + ([rows[k][-1]] if len(rows[k]) % 2 else [])
        return [np.array([p], dtype=enc.dtype) if r is None else r[0][3] for p, r in zip(pieces, rows)]

    def _halve(self, raw: bytes, a: int, b: int) -> list:
        """Ends of the leaves: equal parts, 2^k of them, moved to the next start of a character."""
        parts = 1
        while (b - a) / parts > self.leaf:
            parts *= 2
        cuts = {a, b}
        for i in range(1, parts):
            c = a + (b - a) * i // parts
            while c < b and raw[c] & 0xC0 == 0x80:
                c += 1
            cuts.add(c)
        return sorted(cuts)

    def _join(self, pairs: list) -> list:
        out, todo, width = [None] * len(pairs), list(range(len(pairs))), 64
        while todo:
            plans = [self._window(*pairs[i], width) for i in todo]
            self.windows += len(todo)
            coded = self.encoder.encode([pairs[i][0][0][p[0] : p[1]].decode() for i, p in zip(todo, plans)])
            left = []
            for i, plan, ids in zip(todo, plans, coded):
                out[i] = self._splice(*pairs[i], plan, ids)
                if out[i] is None:
                    left.append(i)
            todo, width = left, width * 2
        return out

    def _window(self, a, b, width: int):
        """(start, end, start is safe, end is safe, tokens of a before start, tokens of b before end)."""
        raw, low, mid, high = a[0], a[1], a[2], b[2]
        s = next((i for i in range(mid, max(low, mid - width), -1) if i > low and _breaks(raw[i - 1], raw[i])), None)
        e = next((i for i in range(mid, min(high, mid + width)) if i > low and _breaks(raw[i - 1], raw[i])), None)
        la, lb = self.encoder.lengths(a[3]), self.encoder.lengths(b[3])
        ends = low + np.cumsum(la)
        starts = mid + np.concatenate(([0], np.cumsum(lb)))
        safe_s, safe_e = s is not None or mid - width <= low, e is not None or mid + width >= high
        if s is None:
            s = low
            if not safe_s:
                k = int(np.searchsorted(ends, mid - width // 2))
                while k > 0 and raw[int(ends[k - 1])] & 0xC0 == 0x80:
                    k -= 1
                s, safe_s = (int(ends[k - 1]), False) if k > 0 else (low, True)
        if e is None:
            e = high
            if not safe_e:
                k = int(np.searchsorted(starts, mid + width // 2))
                while k < len(lb) and raw[int(starts[k])] & 0xC0 == 0x80:
                    k += 1
                e, safe_e = (int(starts[k]), False) if k < len(lb) else (high, True)
        na = int(np.searchsorted(ends, s, "right"))
        nb = int(np.searchsorted(starts, e))
        return s, e, safe_s, safe_e, na, nb

    def _alike(self, raw: bytes, a: int, b: int) -> bool:
        """Whether the characters around and between a and b are of one class."""
        while a > 0 and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        return len({_kind(c) for c in raw[a:b].decode()}) == 1

    def _splice(self, a, b, plan, ids):
        s, e, safe_s, safe_e, na, nb = plan
        raw = a[0]
        if not safe_s:
            n = len(ids) and int(self.encoder.lengths(ids[:1])[0])
            if not n or na >= len(a[3]) or a[3][na] != ids[0] or s + n >= a[2] or not self._alike(raw, s - 1, s + n + 1):
                return None
        if not safe_e:
            n = len(ids) and int(self.encoder.lengths(ids[-1:])[0])
            if not n or nb < 1 or b[3][nb - 1] != ids[-1] or e - n <= b[1] or not self._alike(raw, e - n - 1, e + 1):
                return None
        return raw, a[1], b[2], np.concatenate((a[3][:na], ids, b[3][nb:]))
