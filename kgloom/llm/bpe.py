"""BPE encoding by a prefix-sharing trie, and decoding.

The distinct words of a batch are inserted into a trie of their byte-level symbols. A depth-first
walk gives every node the last token of its prefix: the one vocabulary entry that ends there and
that BPE would leave standing beside the last token of the prefix before it. Two tokens stand
side by side if no merge across their seam comes before the merges that made them. So the encoding
of a prefix is computed once for all words that share it, and a word's ids are read off by
stepping back from its end. Words end with a marked symbol, which only occurs at leaves. Many new
words are sorted and walked TRIE_WORDS at a time, so that neighbours still share their prefixes.

A worker remembers the words it has met of late, up to a bound; the words of each slice of texts are
found, told apart and put together in Arrow, so Python handles distinct words only.

Defined results: null text is empty and has no ids; special tokens written in a text are matched
as the tokenizer file says; unknown ids don't occur, every byte has a symbol; repeated rows are rows of their own; an empty
table gives an empty result; a tokenizer file with other rules for cutting, merging or joining than those here is an error.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from kgloom.llm.common import fresh, released

#: A worker keeps so many words it has met of late, and as many of the time before; and so many known seams. Results don't depend on it.
KNOWN_WORDS = 100_000
#: Words, in sorted order, whose trie is held at a time.
TRIE_WORDS = 20_000
#: Bytes of text that are cut into words at a time.
SLICE_BYTES = 2_000_000
#: Texts with these aren't plain: characters beyond Latin-1, white space beyond ASCII, special tokens.
NOT_PLAIN = r"[^\x{00}-\x{ff}]|[\x{85}\x{a0}]|<\|"
#: What the tokenizer file's pattern cuts off besides runs of letters, in ASCII and in general; texts for the general one.
CUT_ASCII = r"([0-9]|[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+)"
CUT = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\x09-\x0d\x20\pL\pN]+)"
NEEDS_CUT = r"['\x{80}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}\x{d7}\x{f7}]"


def _byte_symbols() -> dict[int, str]:
    """Latin-1 characters to the byte-level symbols of their UTF-8: printable bytes are themselves, others follow from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in shown]
    symbol = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(symbol[b] for b in chr(c).encode()) for c in range(256)}


BYTE_SYMBOLS = _byte_symbols()


#: How the words of a text are found, as the tokenizer file must say it: these are the rules that CUT_ASCII and CUT follow (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def checked(path: str) -> dict:
    """The tokenizer file, if this module reads texts as it says; else an error, as ids would be wrong."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    plain = not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges", "dropout"))
    if model["type"] != "BPE" or not plain or spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER or spec["decoder"] is not None:
        raise ValueError(f"{path} cuts, merges or joins texts by other rules than these operators do")
    return spec


class TrieEncoder:
    """Encodes words with the BPE model of a tokenizer file."""

    def __init__(self, path: str):
        spec = checked(path)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        tool = Tokenizer.from_file(path)
        self.normalize, self.split = tool.normalizer.normalize_str, tool.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.size = tool.get_vocab_size()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = self.vocab[a + b]
            self.rank[self.vocab[a], self.vocab[b]] = r
            if whole not in self.made:
                self.made[whole], self.parts[whole] = r, (self.vocab[a], self.vocab[b])
        self.seams: dict[int, bool] = {}
        #: Tokens that BPE makes of their own text; the others never stand in an encoding.
        whole = set(self.vocab.values()) - set(self.made)
        for t in sorted(self.made, key=self.made.__getitem__):
            a, b = self.parts[t]
            if a in whole and b in whole and self._stands(a, b, self.made[t]):
                whole.add(t)
        self.inner = {t: i for t, i in self.vocab.items() if i in whole and not (self.end and t.endswith(self.end))}
        self.final = {t.removesuffix(self.end): i for t, i in self.vocab.items() if i in whole and t.endswith(self.end)}

    def _stands(self, a: int, b: int, before: float) -> bool:
        """Whether no merge of rank under `before` joins symbols over the seam of a and b.

        The seam is followed back in time by undoing the later of the merges that made its two
        sides. A pair over the seam merges unless a side is used up earlier by its own token; of
        pairs of the same rank, the left one comes first.
        """
        until_a = until_b = before
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < until_a and r <= until_b:
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until_a, a = made_a, self.parts[a][1]
            else:
                until_b, b = made_b, self.parts[b][0]

    def _side_by_side(self, a: int, b: int) -> bool:
        if len(self.seams) >= KNOWN_WORDS:
            self.seams.clear()
        found = self.seams[a << 20 | b] = self._stands(a, b, float("inf"))
        return found

    def _words(self, text: str) -> list[str | int]:
        """The words of a text in byte-level symbols; special tokens as ids."""
        out: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w for w, _ in self.split(self.normalize(part))]
        return out

    def _token_at(self, tail: str, depth: int, last: list[int], width: list[int], tokens: dict[str, int]) -> tuple[int, int]:
        """The last token, and its width, of the prefix of `depth` symbols that ends in `tail`."""
        seams, n = self.seams, width[depth - 1] + 1  # most often, the last token has grown by a symbol
        size = len(tail)
        tried = n if n < size else 0
        n = tried or size
        while n:
            t = tokens.get(tail[-n:])
            if t is not None:
                if n == depth:
                    return t, n
                seam = last[depth - n] << 20 | t
                stands = seams.get(seam)
                if stands is None:
                    stands = self._side_by_side(last[depth - n], t)
                if stands:
                    return t, n
            if n == tried:
                n, tried = size + 1, 0
            n -= 1
        raise ValueError("no token ends this prefix")

    def walk(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each distinct word, by one depth-first walk over their trie."""
        root: dict = {}
        for w in words:
            node = root
            for c in w[:-1]:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(w)  # its marked last symbol is a leaf
        out: dict[str, list[int]] = {}
        longest = self.longest
        last, width = [0], [0]  # of the prefix of each length on the path
        stack: list[tuple[int, str, dict]] = [(0, "", root)]
        while stack:
            depth, tail, node = stack.pop()
            if depth:
                if depth == len(last):
                    last.append(0)
                    width.append(0)
                last[depth], width[depth] = self._token_at(tail, depth, last, width, self.inner)
            for c, child in node.items():
                if c:
                    stack.append((depth + 1, (tail + c)[-longest:], child))
                    continue
                for w in child:
                    t, n = self._token_at((tail + w[-1])[-longest:], depth + 1, last, width, self.final)
                    ids, at = [t], depth + 1 - n
                    while at:
                        ids.append(last[at])
                        at -= width[at]
                    ids.reverse()
                    out[w] = ids
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each distinct plain word, as native unsigned 32-bit integers."""
        symbols = [w.translate(BYTE_SYMBOLS) for w in words]
        order, ids = sorted(symbols), {}
        for a in range(0, len(order), TRIE_WORDS):
            ids |= {w: array("I", x).tobytes() for w, x in self.walk(order[a : a + TRIE_WORDS]).items()}
        return [ids[w] for w in symbols]

    def encode_text(self, text: str) -> list[int]:
        """The ids of any text, its words found by the tokenizer file's own rules."""
        words = self._words(text)
        ids = self.walk({w for w in words if isinstance(w, str)})
        return [x for w in words for x in (ids[w] if isinstance(w, str) else (w,))]


class LibraryEncoder:
    """The same over the tokenizers library's own encoder."""

    def __init__(self, path: str):
        checked(path)
        self.tool = Tokenizer.from_file(path)
        self.final = np.array([self.tool.id_to_token(i).endswith("</w>") for i in range(self.tool.get_vocab_size())])

    def encode_words(self, words: list[str], at_once: int = 4096) -> list[bytes]:
        """Many words make one text; each word's ids end with a word-end token."""
        texts = [" ".join(words[i : i + at_once]) for i in range(0, len(words), at_once)]
        # the batch call leaves out the offsets, which nobody asks for; one text a call, so no threads beside Spark's
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(self.tool.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts)])
        ends = (np.flatnonzero(self.final[ids]) + 1).tolist()
        if len(ends) != len(words):
            raise ValueError("words and word ends differ")
        data = memoryview(ids).cast("B")
        return [bytes(data[4 * a : 4 * b]) for a, b in zip([0, *ends], ends)]

    def encode_text(self, text: str) -> list[int]:
        return self.tool.encode(text, add_special_tokens=False).ids


class Words:
    """Encodes Arrow texts: finds their distinct words in Arrow, encodes the new ones, and gathers.

    Texts of Latin-1 characters are lower-cased and cut in Arrow; any other text, and one that may hold
    a special token, goes by the encoder's own rules.
    """

    def __init__(self, encoder: TrieEncoder | LibraryEncoder, keep: int = KNOWN_WORDS, slice_bytes: int = SLICE_BYTES):
        self.encoder, self.keep, self.slice_bytes, self.known, self.older = encoder, keep, slice_bytes, {}, {}

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The number of ids of each text and all ids, for one slice of the texts after the other."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        place = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // self.slice_bytes
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield self._encode(texts.slice(a, b - a))

    def _ids(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct words. Words of the older half that are met again move to the newer one."""
        if len(self.known) >= self.keep:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for w in distinct:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        known.update(zip(new, self.encoder.encode_words(new), strict=True))
        return [known[w] for w in distinct]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, NOT_PLAIN)
        lower = pc.utf8_lower(pc.if_else(odd, "", texts))
        general = pc.match_substring_regex(lower, NEEDS_CUT)
        spaced = pc.replace_substring_regex(pc.if_else(general, "", lower), CUT_ASCII, r" \1 ")
        if pc.any(general).as_py():
            spaced = pc.if_else(general, pc.replace_substring_regex(pc.if_else(general, lower, ""), CUT, r" \1 "), spaced)
        lists = pc.ascii_split_whitespace(spaced)
        words = lists.flatten()
        full = pc.greater(pc.binary_length(words), 0)
        ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        coded = words.filter(full).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        parts = self._ids(distinct)
        ids = np.frombuffer(b"".join(parts), np.uint32)
        width = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        out, n = gather(ids, np.cumsum(width) - width, width, coded.indices.to_numpy(zero_copy_only=False))
        total = np.concatenate(([0], np.cumsum(n)))[ends]
        lengths = np.diff(total)
        if not pc.any(odd).as_py():
            return lengths, out
        rest = {i: self.encoder.encode_text(texts[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        out = np.concatenate([np.array(rest[i], np.uint32) if i in rest else out[a:b] for i, (a, b) in enumerate(zip(total.tolist(), total[1:].tolist()))])
        for i, x in rest.items():
            lengths[i] = len(x)
        return lengths, out


def gather(values: np.ndarray, start: np.ndarray, width: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[start : start + width] of each of `which`, one after the other; their widths."""
    n = width[which]
    at = np.repeat(start[which] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return values[at], n


@cache
def trie_words(path: str) -> Words:
    return Words(TrieEncoder(path))


@cache
def library_words(path: str) -> Words:
    return Words(LibraryEncoder(path), 300_000, 3 * SLICE_BYTES)


@cache
def token_names(path: str) -> pa.Array:
    tool = Tokenizer.from_file(path)
    return pa.array([tool.id_to_token(i) for i in range(tool.get_vocab_size())])


def with_codes(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The rows with their `ids` and the text `decoded` from those. Columns of the input with these names stay, with a _ before them."""
    for c in docs.columns:
        if c.lower() in ("ids", "decoded"):
            kept = fresh(f"_{c}", docs)
            docs, text_col = docs.withColumnRenamed(c, kept), kept if text_col == c else text_col
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = trie_words(path), token_names(path)
        for batch in batches:
            done = 0
            for n, x in words.encode(batch.column(at)):  # a slice at a time, so ids and texts of a whole batch are never held
                ids = _lists(n, x)
                yield pa.RecordBatch.from_arrays([*batch.slice(done, len(n)).columns, ids, joined(ids, names)], names=[*batch.schema.names, "ids", "decoded"])
                done += len(n)

    return docs.mapInArrow(released(each), schema)


def _lists(lengths: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(ids.view(np.int32)))


def joined(lists: pa.ListArray, names: pa.Array) -> pa.Array:
    """The tokens of each list joined by a space; null stays null."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), names.take(lists.flatten()))
    return pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), pc.binary_join(tokens, " "))


def encode(text: Column, path: str) -> Column:
    """text -> array<int> of token ids. The file at `path` is read by each worker."""

    def ids(texts: pa.Array) -> pa.Array:
        found = [_lists(n, x) for n, x in trie_words(path).encode(texts)]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(ids, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """array<int> -> text: the tokens joined by a space, as the tokenizer file without decoder says; null stays null."""

    def texts(lists: pa.Array) -> pa.Array:
        out = [joined(lists.slice(a, 1000), token_names(path)) for a in range(0, len(lists), 1000)]
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return F.arrow_udf(texts, "string")(ids)
