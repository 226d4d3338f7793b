"""BPE encoding by forced boundaries, and decoding.

From the vocabulary follows which byte pairs occur inside any token (a pair that ends a word and one that does not are
told apart). A merge always yields a token, so no merge crosses a pair that no token has: such pairs are certain cuts.
Each pre-token is cut there, the fragments are encoded on their own, every distinct one once, and concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from galeframe.llm.common import map_batches, process_store, release_memory, slices

END = "</w>"
#: Characters for which Python's tables might differ from the tokenizer's; texts with one take its own rules.
ODD = re.compile("[\x1c-\x1fͰ-\U0010ffff]")
CACHE_ROWS = 60_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next letter after Latin-1."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    out = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Cache:
    """Ids of what was encoded before, in two generations: what is still used when the young one fills up stays."""

    def __init__(self, rows: int = CACHE_ROWS):
        self.rows, self.young, self.old = rows, {}, {}

    def look_up(self, keys: list, learn: Callable[[list], list[bytes]], step: int = 1 << 14) -> list[bytes]:
        """The ids of all keys; those never met are learnt, each once."""
        out = list(map(self.young.get, keys))
        if None not in out:
            return out
        missing = [i for i, v in enumerate(out) if v is None]
        new = []
        for k in {keys[i] for i in missing}:
            known = self.old.get(k)
            if known is None:
                new.append(k)
            else:
                self.young[k] = known
        for s in range(0, len(new), step):
            self.young.update(zip(new[s:s + step], learn(new[s:s + step])))
        for i in missing:
            out[i] = self.young[keys[i]]
        if len(self.young) > self.rows:
            self.young, self.old = {}, self.young
        return out


class Codec:
    """Encode and decode with a tokenizer file of the byte-level, word-end kind."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.tokens = [""] * (max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in model["vocab"].items():
            self.tokens[i] = token
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.is_end = np.array([t.endswith(END) for t in self.tokens])
        self.letters = byte_letters()
        self.table = dict(enumerate(self.letters))
        self.inner, self.final = self._pairs(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ends = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=END))
        self.insides = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        self.ends.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words = regex.compile(self.pattern)
        self.own_words = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        self.own_normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.token_array = pa.array(self.tokens)
        self.chunks, self.known = Cache(), Cache()

    def _pairs(self, vocab: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        back = {c: b for b, c in enumerate(self.letters)}
        inner, final = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
        for token in vocab:
            word = token.removesuffix(END)
            b = [back[c] for c in word]
            for i in range(len(b) - 1):
                (final if word != token and i == len(b) - 2 else inner)[b[i], b[i + 1]] = True
        return inner, final

    def fragments(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """All fragments of the words in order, and how many each word has. A fragment that ends its word ends in a space."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = b" ".join(words) + b" "
        a = np.frombuffer(data, np.uint8)
        space = np.cumsum(size + 1) - 1
        cut = ~self.inner[a[:-1], a[1:]]
        ends = space[size > 1] - 2
        cut[ends] = ~self.final[a[ends], a[ends + 1]]
        cut[space - 1] = False
        cut[space[:-1]] = True
        stops = np.append(np.flatnonzero(cut), len(a) - 1)
        count = np.diff(np.searchsorted(stops, space, side="right"), prepend=0)
        stops = (stops + 1).tolist()
        return [data[s:e] for s, e in zip([0, *stops[:-1]], stops)], count

    def _letters(self, fragment: bytes) -> str:
        text = fragment.decode("latin-1")
        return text if text.isascii() and text.isprintable() else text.translate(self.table)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Encode fragments on their own."""
        out: dict[bytes, bytes] = {}
        ending = [f for f in new if f.endswith(b" ")]
        if ending:
            ids = np.array(self.ends.encode_batch_fast([" ".join(self._letters(f[:-1]) for f in ending)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            data = ids.tobytes()
            out.update(zip(ending, [data[s:e] for s, e in zip([0, *stops[:-1]], stops)]))
        inside = [f for f in new if not f.endswith(b" ")]
        for f, e in zip(inside, self.insides.encode_batch_fast(list(map(self._letters, inside)), add_special_tokens=False)):
            out[f] = np.array(e.ids, "<u4").tobytes()
        return list(map(out.__getitem__, new))

    def _encode_words(self, words: list[str], per_group: np.ndarray) -> list[bytes]:
        """Ids of each group of pre-tokens, concatenated."""
        if not words:
            return [b""] * len(per_group)
        fragments, count = self.fragments(list(map(str.encode, words)))
        coded = self.known.look_up(fragments, self._learn)
        of_group = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(per_group))].tolist()
        return [coded[s] if e == s + 1 else b"".join(coded[s:e]) for s, e in zip(of_group, of_group[1:])]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of stretches between white space."""
        words: list[str] = []
        count = np.ones(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            if c.isalpha():
                words.append(c)
            else:
                found = self.words.findall(c)
                count[i] = len(found)
                words += found
        return self._encode_words(words, count)

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts without special tokens."""
        odd = {i: [w for w, _ in self.own_words.pre_tokenize_str(self.own_normal.normalize_str(t))] for i, t in enumerate(texts) if ODD.search(t)}
        folded = ["" if i in odd else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower() for i, t in enumerate(texts)]
        lists = pc.ascii_split_whitespace(pa.array(folded, pa.large_string()))
        chunks = lists.flatten().dictionary_encode()
        known = pa.array(self.chunks.look_up(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), self._encode_chunks), pa.large_binary())
        out = _joined(lists.offsets, known.take(chunks.indices))
        for i, ids in zip(odd, self._encode_words([w for ws in odd.values() for w in ws], np.array([len(ws) for ws in odd.values()], np.int64))):
            out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a missing text has none."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            if t and "<|" in t:
                pieces = self.split_special.split(t)
            else:
                pieces = [t or ""]
            parts += pieces
            owner += [i] * len(pieces)
        plain = self._encode_plain(["" if p in self.special else p for p in parts])
        out: list[list[bytes]] = [[] for _ in texts]
        for i, p, ids in zip(owner, parts, plain):
            out[i].append(np.array([self.special[p]], "<u4").tobytes() if p in self.special else ids)
        return [b[0] if len(b) == 1 else b"".join(b) for b in out]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The tokens of each text's ids, special ones too, joined by spaces: this kind of file names no decoder."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        offsets = np.cumsum([0, *(len(i) // 4 for i in ids)])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.token_array.take(pa.array(flat))), " ").to_pylist()


def _joined(groups: pa.Array, values: pa.Array) -> list[bytes]:
    """Values of each group (given by its first index), which lie one after the other in memory."""
    first, last = values.offset, values.offset + len(values)
    at = np.frombuffer(values.buffers()[1], np.int64)[first:last + 1] if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2].to_pybytes() if len(values) and values.buffers()[2] is not None else b""
    stops = at[groups.to_numpy()].tolist()
    return [data[s:e] for s, e in zip(stops, stops[1:])]


def worker_codec(file: str) -> Codec:
    """The codec of this Python worker, built once."""
    store = process_store("codecs")
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in store:
        store[key] = Codec(file)
    return store[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids`` (little-endian 32 bit).

    A missing or empty text has no ids and decodes to the empty text. Rows are independent of each other, so repeated
    rows and ids give repeated results; other columns are not read.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec = worker_codec(file.value)
        for batch in slices(batches, "text", 4 << 20):
            ids = codec.encode(batch.column("text").to_pylist())
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids]}
            out["decoded_sha256"] = [hashlib.sha256(d.encode()).hexdigest() for d in codec.decode(ids)]
            yield out | {"ids": ids}
            del ids, out
            release_memory()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema)
