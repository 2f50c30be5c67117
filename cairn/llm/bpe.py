"""Byte-level BPE by per-prefix dynamic programming.

For every prefix of a pre-token exactly one vocabulary token can end its BPE encoding. A suffix
automaton over the vocabulary lists the tokens that end at each position; of those, the one whose
junction with the shorter prefix's last token BPE would itself produce is kept. Following the stored
tokens back from the end gives the ids, without simulating the merges.

Defined results: a null text encodes as the empty text, an empty text to no ids; null ids decode to
the empty text; an id outside the vocabulary raises. Texts of any length are handled whole, in
slices of pre-tokens. Repeated rows give repeated results. Columns besides the named one pass
through; one that has the output's name is replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import pickle
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.frames import map_columns

#: The published pre-tokenization pattern of this family of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens a worker remembers, and the longest it does.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
PAIR_ENTRIES = 500_000
#: Characters handled at once of one text, and ids decoded at once.
SLICE_CHARS, SLICE_IDS = 1 << 20, 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The vocabulary files' printable stand-in for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the suffix automaton, as compact arrays that can be broadcast."""

    def __init__(self, tokens, left, right, rank, pairs, specials, automaton):
        self.tokens, self.left, self.right, self.rank, self.pairs = tokens, left, right, rank, pairs
        self.specials, self.automaton = specials, automaton

    @classmethod
    def from_json(cls, content: str) -> Vocabulary:
        spec = json.loads(content)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE without normalizer, dropout or ignored merges is supported")
        as_bytes = lambda s: bytes(map(alphabet.__getitem__, s))
        before, after = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or after.get("type") != "ByteLevel":
            raise ValueError("only byte-level pre-tokenizers and decoders without a prefix space are supported")
        n = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        tokens: list[bytes | None] = [None] * n
        for text, i in model["vocab"].items():
            tokens[i] = as_bytes(text)
        specials = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens with stripping or word bounds are not supported")
            specials[t["content"]] = t["id"]
            tokens[t["id"]] = t["content"].encode()
        left, right, rank = np.full(n, -1, "i4"), np.full(n, -1, "i4"), np.full(n, -1, "i4")
        pairs, vocab = {}, model["vocab"]
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            pairs[a << 32 | b] = r, made
            if rank[made] < 0:
                left[made], right[made], rank[made] = a, b, r
        own = set(specials.values())
        alive = [i for i, t in enumerate(tokens) if t is not None and i not in own and (len(t) == 1 or cls._merged(t, tokens, pairs, vocab) == i)]
        keys = np.fromiter(pairs, "i8", len(pairs))
        ranks = np.fromiter((r for r, _ in pairs.values()), "i4", len(pairs))
        return cls(tokens, left, right, rank, (keys, ranks), specials, suffix_automaton({tokens[i]: i for i in alive}))

    @staticmethod
    def _merged(token: bytes, tokens, pairs, vocab, _single={}) -> int:  # noqa: B006
        """The one id that merging the token's own bytes by rank ends in, or -1."""
        if not _single or _single.get("of") is not tokens:
            _single.clear()
            _single |= {"of": tokens, **{t[0]: i for i, t in enumerate(tokens) if t is not None and len(t) == 1}}
        ids = [_single[b] for b in token]
        while len(ids) > 1:
            best = min(((pairs[k][0], k) for a, b in zip(ids, ids[1:]) if (k := a << 32 | b) in pairs), default=None)
            if best is None:
                return -1
            made, a, b, out, i = pairs[best[1]][1], best[1] >> 32, best[1] & 0xFFFFFFFF, [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids[0]


def suffix_automaton(words: dict[bytes, int]) -> dict[str, np.ndarray]:
    """A suffix automaton of all words together, with the words that each state's suffixes are.

    ``goto`` maps state*256+byte to the next state; ``link`` is the suffix link; ``term`` is the
    nearest state on the link path, itself included, that holds words; ``held_*`` list a state's
    words, longest first.
    """
    nexts: list[dict[int, int]] = [{}]
    link, longest = array("i", [-1]), array("i", [0])

    def split(p: int, q: int, byte: int) -> int:
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        link[q] = made = len(nexts) - 1
        while p >= 0 and nexts[p].get(byte) == q:
            nexts[p][byte] = made
            p = link[p]
        return made

    for word in words:
        last = 0
        for byte in word:
            q = nexts[last].get(byte)
            if q is not None:
                last = q if longest[q] == longest[last] + 1 else split(last, q, byte)
                continue
            nexts.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            now, p = len(nexts) - 1, last
            while p >= 0 and byte not in nexts[p]:
                nexts[p][byte] = now
                p = link[p]
            if p >= 0:
                q = nexts[p][byte]
                link[now] = q if longest[q] == longest[p] + 1 else split(p, q, byte)
            last = now

    held: dict[int, list[tuple[int, int]]] = {}
    for word, i in words.items():
        state = 0
        for byte in word:
            state = nexts[state][byte]
        held.setdefault(state, []).append((len(word), i))
    links, depth = np.array(link, "i4"), np.array(longest, "i4")
    term = np.zeros(len(links), "i4")
    for state in np.argsort(depth, kind="stable").tolist():
        term[state] = state if state in held else (term[links[state]] if state else 0)
    goto_keys = np.fromiter((s << 8 | b for s, d in enumerate(nexts) for b in d), "i4")
    goto_vals = np.fromiter((t for d in nexts for t in d.values()), "i4")
    flat = [(s, n, i) for s, found in held.items() for n, i in sorted(found, reverse=True)]
    held_state, held_len, held_id = (np.array(x, "i4") for x in zip(*flat, strict=True))
    return {"goto_keys": goto_keys, "goto_vals": goto_vals, "link": links, "longest": depth, "term": term, "held_state": held_state, "held_len": held_len, "held_id": held_id}


class Codec:
    """Encodes and decodes with a vocabulary; keeps a bounded memo of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        v, a = vocabulary, vocabulary.automaton
        self.tokens = v.tokens
        self._left, self._right, self._rank = v.left.tolist(), v.right.tolist(), v.rank.tolist()
        self._pairs = dict(zip(v.pairs[0].tolist(), v.pairs[1].tolist(), strict=True))
        self._goto = dict(zip(a["goto_keys"].tolist(), a["goto_vals"].tolist(), strict=True))
        self._link, self._longest = a["link"].tolist(), a["longest"].tolist()
        self._fits: dict[int, dict[int, bool]] = {}
        self._n_fits = 0
        held: dict[int, list] = {}
        for s, n, i in zip(a["held_state"].tolist(), a["held_len"].tolist(), a["held_id"].tolist(), strict=True):
            # by the last token of the shorter prefix, whether this one may follow it; -1 is the start
            held.setdefault(s, []).append((n, i, self._fits.setdefault(i, {-1: True})))
        link, term = self._link, a["term"].tolist()

        class Ending(dict):
            """Per state, the words among its suffixes, longest first."""

            def __missing__(self, state: int) -> list:
                at, found = term[state], []
                while at:
                    found += held[at]
                    at = term[link[at]]
                self[state] = found
                return found

        self._ending = Ending()
        self._find = regex.compile(PATTERN)
        self._specials = v.specials
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.specials, key=len, reverse=True))) + ")") if v.specials else None
        codec = self

        older: dict[str, bytes] = {}

        class Memo(dict):
            """Two generations: what is not asked for while the younger one fills goes."""

            def __missing__(self, word: str) -> bytes:
                packed = older.pop(word, None)
                if packed is None:
                    packed = array("I", codec._pretoken(word.encode())).tobytes()
                if len(word) <= MEMO_CHARS:
                    if len(self) >= MEMO_ENTRIES // 2:
                        older.clear()
                        older.update(self)
                        self.clear()
                    self[word] = packed
                return packed

        self._packed = Memo().__getitem__

    def _fit(self, a: int, b: int) -> bool:
        """Whether BPE leaves a boundary between a and b: no merge across it comes before it should."""
        rank, left, right, pairs = self._rank, self._left, self._right, self._pairs
        bound = 1 << 40  # a merge across the boundary that comes before this one would have happened
        while True:
            across = pairs.get(a << 32 | b)
            if across is not None and across < bound:
                return False
            # Undo the later of the two tokens' own last merges: the pieces that met before it.
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, a = ra, right[a]
            else:  # of equal merges the left one comes first
                bound, b = rb + (1 if ra <= rb else 0), left[b]

    def _pretoken(self, data: bytes) -> list[int]:
        n = len(data)
        goto, link, longest, ending = self._goto, self._link, self._longest, self._ending
        if self._n_fits > PAIR_ENTRIES:
            self._n_fits = 0
            for known in self._fits.values():
                known.clear()
                known[-1] = True
        last, sizes = [-1] * (n + 1), [0] * (n + 1)
        state = matched = 0
        for end, byte in enumerate(data, 1):
            while (to := goto.get(state << 8 | byte)) is None:
                state = link[state]
                matched = longest[state]
            state = to
            matched += 1
            for size, token, fits in ending[state]:
                if size <= matched:
                    before = last[end - size]
                    fit = fits.get(before)
                    if fit is None:
                        fit = fits[before] = self._fit(before, token)
                        self._n_fits += 1
                    if fit:
                        last[end], sizes[end] = token, size
                        break
        ids = []
        while n:
            ids.append(last[n])
            n -= sizes[n]
        ids.reverse()
        return ids

    def _pieces(self, text: str):
        """Packed ids of the text, in slices."""
        for i, part in enumerate(self._cut.split(text) if self._cut and self._cut.search(text) else (text,)):
            if i & 1:
                yield array("I", [self._specials[part]]).tobytes()
            elif len(part) <= SLICE_CHARS:
                yield b"".join(map(self._packed, self._find.findall(part)))
            else:
                matches = (m[0] for m in self._find.finditer(part))
                while some := list(islice(matches, SLICE_CHARS // 4)):
                    yield b"".join(map(self._packed, some))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self._pieces(text or ""))

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that aren't UTF-8 become replacement characters."""
        raw = self.decode_raw(packed)
        try:
            codecs.utf_8_decode(raw, "strict", True)
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def decode_raw(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        get = self.tokens.__getitem__
        return b"".join(b"".join(map(get, ids[i : i + SLICE_IDS].tolist())) for i in range(0, len(ids), SLICE_IDS))


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a worker process and vocabulary."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(pickle.loads(shared.value))
    return _codecs[shared.id]


class _Shared:
    """A broadcast with an identity that survives the trip to a worker."""

    def __init__(self, spark: SparkSession, value: bytes):
        self.id, self._held = hashlib.sha256(value).hexdigest(), spark.sparkContext.broadcast(value)

    @property
    def value(self) -> bytes:
        return self._held.value


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(spark: SparkSession, path: str) -> _Shared:
    """Read a vocabulary file on the driver and broadcast it (bounded by the vocabulary: a few MB)."""
    with open(path, encoding="utf-8") as f:
        return _Shared(spark, pickle.dumps(Vocabulary.from_json(f.read())))


def encode(df: DataFrame, shared: _Shared, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """Add the ids of each text as ``array<int>``."""

    def kernel():
        codec = _codec(shared)

        def run(columns):
            ids = [np.frombuffer(codec.encode(t.as_py()), "<i4") for t in columns[0]]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
            return [pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, "i4"), *ids]))]

        return run

    return map_columns(df, [text_col], f"`{out_col}` array<int>", kernel)


def decode(df: DataFrame, shared: _Shared, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of each row of ids."""

    def kernel():
        codec = _codec(shared)

        def run(columns):
            return [pa.array([codec.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode() for x in columns[0]], pa.string())]

        return run

    return map_columns(df, [ids_col], f"`{out_col}` string", kernel)


def round_trip(df: DataFrame, shared: _Shared, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text's encoding and its decoding.

    The ids stay in the worker: only their digests leave it.
    """

    def kernel():
        codec = _codec(shared)

        def run(columns):
            counts, ids, texts = [], [], []
            for t in columns[0]:
                packed = codec.encode(t.as_py())
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]

        return run

    return map_columns(df, [text_col], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", kernel, keep)
