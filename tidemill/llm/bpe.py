"""BPE encoding and decoding with a public vocabulary file.

Words are encoded in batches: the symbols of all words that a worker hasn't met lie in one flat array; each
numpy round finds every adjacent pair's rank by binary search over the sorted pair keys, takes the lowest rank
of each word, and merges its occurrences from the left. Words end when no pair of theirs has a rank.

Defined results: null and empty texts give no tokens (and an empty decoded text); special tokens that stand in a
text are taken as such, as the library does by default; repeated rows are encoded alike; columns other than the id
and the text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import gather, id_text, map_chunks
from tidemill.session import ship

#: The contractions of the vocabulary's pre-tokenizer, and white space as it takes it.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE = r"\t-\r \x85\xa0  -     　"
#: Letters, numbers and small letters of Unicode 16 (and of 17, the small ones) that the tokenizers library
#: knows beside those of Unicode 15.1, as ranges of code points.
NEWER_LETTERS = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 "
    "113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
)
NEWER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER_LOWER |= {i: i + 0x20 for i in range(0x10D50, 0x10D66)} | {i: i + 0x1B for i in range(0x16EA0, 0x16EB9)}

#: Combining marks (and one vowel sign that composes) that the library's normaliser, whose tables are older,
#: leaves where they are, as ranges of code points.
FIXED_MARKS = (
    "7fd-7fd 898-89f 8ca-8d3 9fe-9fe c3c-c3c d3b-d3c eba-eba 1715-1715 1abf-1ace 1df6-1dfa a82c-a82c 10d24-10d27 10eab-10eac 10efd-10eff "
    "10f46-10f50 10f82-10f85 11070-11070 1133b-1133b 1145e-1145e 11839-1183a 11930-11930 1193d-1193e 11943-11943 119e0-119e0 11a34-11a34 11a47-11a47 "
    "11a99-11a99 11d42-11d42 11d44-11d45 11d97-11d97 11f41-11f42 16ff0-16ff1 1e08f-1e08f 1e130-1e136 1e2ae-1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)


def class_of(major: str, newer: str) -> tuple[str, str]:
    """The code points of a general category up to Unicode 15.1 and those of `newer`, as ranges of a regular expression:
    all of them, and those below 0x10000, whose look-up is a table's."""
    inside = np.fromiter((unicodedata.category(chr(i))[0] == major for i in range(0x110000)), bool, 0x110000)
    for run in newer.split():
        first, last = (int(x, 16) for x in run.split("-"))
        inside[first : last + 1] = True
    edges = (np.flatnonzero(np.diff(np.r_[False, x, False].astype(np.int8))) for x in (inside, inside[:0x10000]))
    return tuple("".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in e.reshape(-1, 2).tolist()) for e in edges)


CLASSES = list(zip(class_of("L", NEWER_LETTERS), class_of("N", NEWER_NUMBERS), strict=True))
# contractions begin with what is neither letter nor number, so their place before the others' rest is all that counts
ASCII_WORDS = re.compile(rf"[a-z]+|[0-9]|{CONTRACTIONS}|[^\t-\r a-z0-9]+")
#: No fixed mark and no newer capital is below this.
HIGH = re.compile("[\u07fd-\U0010ffff]")
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
ASTRAL_WORDS, WORDS = (re.compile(rf"[{a}]+|[{b}]|{CONTRACTIONS}|[^{WHITE}{a}{b}]+") for a, b in CLASSES)
FIXED_MARK = re.compile("([" + "".join("\\U{:0>8}-\\U{:0>8}".format(*x.split("-")) for x in FIXED_MARKS.split()) + "]+)")
NEWER_CAPITAL = re.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")

#: Words that a worker keeps before it starts anew, some 150 bytes each, and bytes of text that it encodes at once, which
#: take some 60 times that for a while; two workers share an executor's memory with its JVM.
CACHE_WORDS = 150_000
CHUNK_BYTES = 512 << 10
#: Ids that a worker decodes at once.
DECODE_IDS = 1 << 18
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def composed(text: str) -> str:
    """The text in the library's normal form: what stands between fixed marks is composed by itself."""
    if HIGH.search(text) and FIXED_MARK.search(text):
        return "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(FIXED_MARK.split(text)))
    return unicodedata.normalize("NFC", text)


class Codec:
    """Encoder and decoder for one vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        odd = [x["content"] for x in spec["added_tokens"] if x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]]
        if odd:
            raise ValueError(f"{path}: added tokens that are matched in another way than as they stand: {odd}")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        every = vocab | self.special
        self.size = max(every.values()) + 1
        tokens = [""] * self.size
        for token, i in every.items():
            tokens[i] = token
        self.tokens = tokens
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + end] for c in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.into = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split_special = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.token_bytes, self.token_at = self._table([t + " " for t in tokens])
        self.decimal_bytes, self.decimal_at = self._table([f"{i} " for i in range(self.size)])
        self._forget()

    @staticmethod
    def _table(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [s.encode() for s in strings]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.used = 0
        for token, i in self.special.items():
            self._keep([token], np.array([i], np.int32), np.array([1]))

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.known), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m] = self.used + np.cumsum(counts) - counts
        self.counts[n : n + m] = counts
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + m), strict=True))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and each word's number of ids."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym, owner = self.inner[data], np.repeat(np.arange(len(raw)), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        sym[ends] = self.final[data[ends]]
        done_ids, done_owner = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NONE, np.int32)
            rank[:-1] = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], NONE)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            per = np.repeat(lowest, np.diff(np.r_[first, len(sym)]))
            live = per != NONE
            done_ids.append(sym[~live])
            done_owner.append(owner[~live])
            hit = (rank == per) & live
            # of adjacent hits, which overlap, the first, third, ... of each run merge
            spot = np.flatnonzero(hit)
            if len(spot):
                head = np.r_[True, np.diff(spot) > 1]
                run = np.arange(len(spot)) - np.maximum.accumulate(np.where(head, np.arange(len(spot)), 0))
                spot = spot[run % 2 == 0]
                sym = sym.copy()
                sym[spot] = self.into[rank[spot]]
                live[spot + 1] = False
            sym, owner = sym[live], owner[live]
        ids, owner = np.concatenate(done_ids or [sym]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text, special tokens among them as they are."""
        if any(token in text for token in self.special):
            out, last = [], 0
            for m in self.split_special.finditer(text):
                out += [*self._plain(text[last : m.start()]), m[0]]
                last = m.end()
            return out + self._plain(text[last:])
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        # a capital sigma always becomes the inner small one, as lower-casing goes by single characters
        text = composed(text).replace("Σ", "σ")
        if HIGH.search(text):
            if NEWER_CAPITAL.search(text):
                text = text.translate(NEWER_LOWER)
            if ASTRAL.search(text):
                return ASTRAL_WORDS.findall(text.lower())
        return WORDS.findall(text.lower())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and each text's number of ids."""
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self._forget()
        new = list({w for ws in split for w in ws if w not in self.known})
        if new:
            self._keep(new, *self.merge(new))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        index = np.fromiter((self.known[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
        counts = self.counts[index]
        ids = gather(self.flat, self.starts[index], counts)
        total = np.r_[0, np.cumsum(counts)]
        return ids, np.diff(total[np.r_[0, np.cumsum(sizes)]])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The text of each run of ids, in UTF-8: the vocabulary has no decoder, so tokens stand joined by a space."""
        return self._joined(self.token_bytes, self.token_at, ids, counts)

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decimal ids of each run, joined by a space."""
        return self._joined(self.decimal_bytes, self.decimal_at, ids, counts)

    @staticmethod
    def _joined(data: np.ndarray, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        size = at[ids + 1] - at[ids]
        flat = gather(data, at[ids], size).tobytes()
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]].tolist()
        return [flat[a : b - 1] if b > a else b"" for a, b in zip(ends, ends[1:], strict=False)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file, read once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def vocabulary() -> str:
    """The place of the default vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the token ids of every whole text. `path`: the vocabulary file, the same on all machines."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = codec(path or vocabulary()).encode(part.column("text").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    df = id_text(docs, id_col, text_col)
    return map_chunks(df, kernel, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>", CHUNK_BYTES)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the decoded text of every row of `encode`; null ids give an empty text."""
    ship(encoded.sparkSession)

    def run(batches):
        for batch in batches:
            lists = batch.column("ids").cast(pa.list_(pa.int64()))
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, at = lists.flatten().to_numpy(), np.r_[0, np.cumsum(counts)]
            i = 0
            while i < len(batch):  # a run of rows with few ids, or one row
                j = max(i + 1, int(np.searchsorted(at, at[i] + DECODE_IDS, "right")) - 1)
                texts = codec(path or vocabulary()).decode(flat[at[i] : at[j]], counts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])
                i = j

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def encoded_with_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256: the token ids, with digests that prove the decoding."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path or vocabulary())
        ids, counts = c.encode(part.column("text").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(counts, pa.int64()), sha(c.decimals(ids, counts)), sha(c.decode(ids, counts))], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = id_text(docs, id_col, text_col)
    return map_chunks(df, kernel, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", CHUNK_BYTES)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `encoded_with_digests`."""
    return encoded_with_digests(docs, path, id_col, text_col).drop("ids")
