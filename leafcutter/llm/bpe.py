"""BPE encoding and decoding with a public tokenizer file, exactly as its library does.

White space is never part of a token here, so texts are cut by Arrow (plain texts into pre-tokens,
others at blanks and line ends), what is cut is made distinct, and each is encoded once per
worker (a bounded memory) by the library; ids are put together by array operations. A
stretch that the pre-tokenizer leaves whole and that is long is encoded by tree
concatenation: its leaves are encoded on their own, in parallel threads of the library;
then neighbours are joined pairwise. At a join, the last and first tokens are encoded
anew together, in a window that grows until its outer tokens are the old ones on both
sides. A sequence of tokens is the BPE encoding exactly if each two neighbours encode to
themselves, so such a join is exact.

Defined cases: a null text counts as empty and gives no ids and an empty decoded text;
repeated rows are encoded each; special tokens written in a text become their ids, as in the
library; further columns are ignored by ``encode_decode`` and kept by ``encode_documents``.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names, table

#: Characters of a pre-token from which tree concatenation is used, and of one leaf.
LONG, LEAF = 1024, 512
#: Distinct pre-tokens, and stretches of other texts, that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
REMEMBERED_STRETCHES = 100_000
#: Bytes of text that are encoded at once.
CHARS = 4_000_000
#: Stretches up to this length are remembered.
SHORT = 64
#: The normaliser and pre-tokenizer for which stretches of plain letters, digits and signs are cut here.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of printable ASCII, Latin-1 letters, blanks and line ends, for which that cut sets blanks
#: around each match of this one, in lower case.
PLAIN = "^[ \n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*$"
PLAIN_CUTS = "('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \na-z0-9\u00df-\u00f6\u00f8-\u00ff]+)"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable in Latin-1, else one from 256 on, in order."""
    seen = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def give_back_memory() -> None:
    """Return what the allocators hold but do not use, so that a worker's size follows its data."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts and texts of ids for the tokenizer in ``spec`` (the file's JSON text)."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.spec = spec
        self._tok, self._word, self._inner = None, None, None
        parsed = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.suffix = parsed["model"].get("end_of_word_suffix") or ""
        vocab = parsed["model"]["vocab"] | self.special
        self.token = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.token[i] = t
        self.token_bytes = [t.encode() for t in self.token]
        self.id_text = [b"%d" % i for i in range(len(self.token))]
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.decodes = parsed.get("decoder") is not None
        steps = (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = parsed["normalizer"] == PLAIN_NORMALIZER and steps[0].get("pattern") == {"Regex": PLAIN_CUT} and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and all("<|" in x for x in self.special)

    # Built when first needed: a worker that meets plain texts alone holds one model.

    @property
    def tok(self):
        if self._tok is None:
            from tokenizers import Tokenizer

            self._tok = Tokenizer.from_str(self.spec)
            self._tok.no_truncation()
            self._tok.no_padding()
            give_back_memory()
        return self._tok

    def _bare(self, **model):
        from tokenizers import Tokenizer

        parsed = json.loads(self.spec)
        parsed |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
        parsed["model"] |= model
        got = Tokenizer.from_str(json.dumps(parsed))
        del parsed
        give_back_memory()
        return got

    @property
    def word(self):
        """The model alone, for whole words."""
        if self._word is None:
            self._word = self._bare()
        return self._word

    @property
    def inner(self):
        """The model alone, for a word's inner part."""
        if self._inner is None:
            self._inner = self._bare(end_of_word_suffix=None)
        return self._inner

    # ------------------------------------------------------------- encoding

    def tree(self, piece: str, leaf: int = LEAF) -> list[int]:
        """Ids of one pre-token by tree concatenation."""
        word, inner = self.word, self.inner
        parts = [piece[i : i + leaf] for i in range(0, len(piece), leaf)]
        runs = [e.ids for e in inner.encode_batch(parts[:-1], add_special_tokens=False)]
        runs.append(word.encode(parts[-1], add_special_tokens=False).ids)
        while len(runs) > 1:
            last = len(runs) - 1
            runs = [self.join(runs[i], runs[i + 1], word if i + 1 == last else inner) if i < last else runs[i] for i in range(0, len(runs), 2)]
        return runs[0]

    def join(self, a: list[int], b: list[int], right) -> list[int]:
        """Ids of the two texts together. ``right``: the model that is right at the end of ``b``."""
        inner = self.inner
        k = 4
        while True:
            wa, wb = min(k, len(a)), min(k, len(b))
            text = "".join(self.token[i] for i in a[len(a) - wa :] + b[:wb])
            whole = wb == len(b)
            if whole and right is not inner and self.suffix:
                text = text.removesuffix(self.suffix)
            got = (right if whole else inner).encode(text, add_special_tokens=False).ids
            left_ok = wa == len(a) or got[:2] == a[len(a) - wa :][:2]
            right_ok = whole or got[-2:] == b[:wb][-2:]
            if left_ok and right_ok:
                return a[: len(a) - wa] + got + b[wb:]
            k *= 2

    def stretch(self, text: str) -> list[int]:
        """Ids of a text that may be long."""
        if len(text) <= LONG:
            return self.tok.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
            pieces = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)] if self.tok.pre_tokenizer else [norm]
            short: list[str] = []
            word = self.word
            for p in [*pieces, None]:
                if p is not None and len(p) <= LONG:
                    short.append(p)
                    continue
                for e in word.encode_batch(short, add_special_tokens=False):
                    ids.extend(e.ids)
                short = []
                if p is not None:
                    ids.extend(self.tree(p))
        return ids

    @staticmethod
    def _flat(encodings, n: int) -> list[bytes]:
        ids = [e.ids for e in encodings]
        flat = np.fromiter((i for x in ids for i in x), dtype="<u4").tobytes()
        ends = np.cumsum([0, *map(len, ids)]) * 4
        return [flat[s:e] for s, e in zip(ends.tolist(), ends.tolist()[1:], strict=False)] if n else []

    @staticmethod
    def _words(model, words: list[str]) -> list[bytes]:
        """Ids of words that the model takes whole, many in one call."""
        out: list[bytes] = []
        lists = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for part, e in zip(lists, model.encode_batch(lists, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4").tobytes()
            ends = np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1)) * 4
            out += [ids[s:e] for s, e in zip(ends.tolist(), ends.tolist()[1:], strict=False)]
        return out

    def _learn_pieces(self, new: list[str]) -> list[str]:
        """Put the ids of new pre-tokens into ``self.pieces``; return those too long to stay."""
        word = self.word
        letters = self.letters
        spelt = [p if p.isascii() else "".join([letters[x] for x in p.encode()]) for p in new]
        short = [i for i, x in enumerate(spelt) if len(x) <= LONG]
        got = self._words(word, [spelt[i] for i in short])
        self.pieces.update(zip([new[i] for i in short], got, strict=True))
        for p, x in zip(new, spelt, strict=True):
            if len(x) > LONG:
                self.pieces[p] = np.array(self.tree(x), dtype="<u4").tobytes()
        return [p for p in new if len(p) > SHORT]

    def _learn_stretches(self, new: list[str]) -> list[str]:
        short = [w for w in new if len(w) <= LONG]
        self.known.update(zip(short, self._flat(self.tok.encode_batch_fast(short, add_special_tokens=False), len(short)), strict=True))
        self.known.update((w, np.array(self.stretch(w), dtype="<u4").tobytes()) for w in new if len(w) > LONG)
        return [w for w in new if len(w) > SHORT]

    def _put_together(self, words: pa.ListArray, memory: str, limit: int, learn) -> tuple[np.ndarray, np.ndarray]:
        flat = words.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        known = getattr(self, memory)
        new = [w for w in names if w not in known]
        if len(known) + len(new) > limit:
            known, new = {}, names
            setattr(self, memory, known)
        long = learn(new) if new else []
        found = [*map(known.__getitem__, names)]
        for w in long:
            del known[w]
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        at = flat.indices.to_numpy()
        each = lengths[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        take = np.repeat(starts[at] - ends[:-1], each) + np.arange(ends[-1])
        edges = words.offsets.to_numpy()
        out = ids[take], ends[edges - edges[0]]
        del words, flat
        pa.default_memory_pool().release_unused()
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), PLAIN_CUTS, r" \1 ")
        return self._put_together(pc.ascii_split_whitespace(spaced), "pieces", REMEMBERED, self._learn_pieces)

    def _other(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return self._put_together(words, "known", REMEMBERED_STRETCHES, self._learn_stretches)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row (uint32), and where each text's ids begin and end."""
        texts = pc.fill_null(texts, "")
        if not self.plain:
            return self._other(texts)
        plain = pc.and_not(pc.match_substring_regex(texts, PLAIN), pc.match_substring(texts, "<|")).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._plain(texts)
        sides = [self._other(texts.filter(pa.array(~plain))), self._plain(texts.filter(pa.array(plain)))]
        place, parts = [0, 0], []
        for p in plain.tolist():
            ids, edges = sides[p]
            parts.append(ids[edges[place[p]] : edges[place[p] + 1]])
            place[p] += 1
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, edges = self.encode_array(pa.array(texts, pa.string()))
        return [ids[s:e].tobytes() for s, e in zip(edges.tolist(), edges.tolist()[1:], strict=False)]

    def forget(self) -> None:
        """Keep the model alone, for workers that go on to other stages."""
        self.known, self.pieces = {}, {}
        give_back_memory()

    # ------------------------------------------------------------- decoding

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8. Without a decoder, the library joins tokens by blanks."""
        if self.decodes:
            return self.tok.decode(ids, skip_special_tokens=False).encode()
        return b" ".join(map(self.token_bytes.__getitem__, ids))

    def decimal(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.id_text.__getitem__, ids))


def shared_spec(spark: SparkSession, path: str | None):
    """The tokenizer file's text, read on the driver and sent once to each executor (a few MB,
    fixed by the file)."""
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(spec) -> Encoder:
    key = hash(spec.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec.value)
    return _ENCODERS[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a text column holds about ``chars`` bytes, one row at least."""
    for b in batches:
        size = b.column(column).nbytes
        step = max(1, b.num_rows * chars // max(size, 1))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """``docs`` with a column of ids (array of int)."""
    spec = shared_spec(docs.sparkSession, path)
    (name,) = fresh_names(docs.columns, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    at = [c.lower() for c in docs.columns].index(text.lower())

    def work(batches):
        enc = worker_encoder(spec)
        for whole in batches:
            for b in slices([whole], whole.schema.names[at]):
                flat, edges = enc.encode_array(b.column(at))
                ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, name])
        enc.forget()

    return docs.mapInArrow(work, schema)


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and return digests of both:
    key, n_tokens, ids_sha256, decoded_sha256."""
    spec = shared_spec(docs.sparkSession, path)
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        enc = worker_encoder(spec)
        for b in slices(batches, "_text"):
            n, a, d = [], [], []
            flat, edges = enc.encode_array(b.column("_text"))
            for start, end in zip(edges.tolist(), edges.tolist()[1:], strict=False):
                ids = flat[start:end].tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(enc.decimal(ids)).hexdigest())
                d.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(work, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
