"""Token counts and ids with the whole-token shortcut.

Offline, once per vocabulary: every vocabulary string is encoded alone; those
that the library gives back as exactly one token, and as one pre-token, are
proven whole. A pre-token found among them counts one and is never merged; only
the other pre-tokens go through the library's merges.

No pre-token reaches across spaces, line ends and tabs, and normalisation does
not either. What a pre-token counts is remembered, in a store of bounded size.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import only, ready, store

#: Entries of a worker's stores, and bytes of pieces and ids in them.
MEMO, HELD_BYTES = 400_000, 32_000_000
#: What a vocabulary file must say of its pre-tokenizer and normaliser (fixed values): pieces are cut by them here.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
#: Pieces cut here, and that pattern for them.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_TEXT = re.compile("[ \n\t\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_SPACE = re.compile("[ \n\t\r]")
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+")


def prove_whole(path: str) -> dict[str, int]:
    """Pre-tokens (in the vocabulary's byte alphabet) proven to encode alone as one token, with its id.

    A vocabulary with another pre-tokenizer or normaliser than the one that
    pieces are cut by here is refused.
    """
    tok = Tokenizer.from_file(path)
    said = json.loads(tok.to_str())
    steps = (said["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    normal = [x["type"] for x in (said["normalizer"] or {}).get("normalizers") or ()]
    if steps[0].get("pattern") != {"Regex": _SPLIT} or [x["type"] for x in steps] != ["Split", "ByteLevel"] or normal != _NORMAL:
        raise ValueError(f"{path}: pieces are cut by another pre-tokenizer or normaliser")
    suffix = tok.model.end_of_word_suffix or ""
    alphabet = _byte_alphabet()
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    found, texts, forms = {}, [], []
    for s in tok.get_vocab(with_added_tokens=False):
        if not s.endswith(suffix) or s in special:
            continue
        form = s[: len(s) - len(suffix)]
        try:
            text = bytes(alphabet[c] for c in form).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if text and not any(x in text for x in special):
            texts.append(text)
            forms.append(form)
    for text, form, e in zip(texts, forms, tok.encode_batch(texts, add_special_tokens=False)):
        if len(e.ids) == 1 and [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))] == [form]:
            found[form] = e.ids[0]
    return found


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WholeTokenEncoder:
    """Ids of whole texts as the library gives them, without added special tokens.

    A text of ASCII and Latin-1 letters, digits, ASCII marks and plain white
    space is cut by the pre-tokenizer's pattern here (no normalisation changes it
    but lower case). Of any other text, pieces between spaces that are like that
    are; the other pieces, and those that hold a special string, are left to the
    library's own steps. Pre-tokens proven whole have their id at once; the
    others new to the store go through the library's merges together: every
    word's last token has the vocabulary's word-end mark.
    """

    def __init__(self, path: str, whole: dict[str, int]):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        alphabet = _byte_alphabet()
        self.proven = {bytes(alphabet[c] for c in form).decode(): np.asarray([i], "<u4").tobytes() for form, i in whole.items()}
        self.by_form = {form: np.asarray([i], "<u4").tobytes() for form, i in whole.items()}
        # merges alone: words already in the byte alphabet, between spaces
        self.merges = Tokenizer(self.tok.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        by_byte = {b: c for c, b in alphabet.items()}
        self.forms = {i: "".join(by_byte[b] for b in chr(i).encode()) for i in range(33, 256)}
        vocab, suffix = self.tok.get_vocab(with_added_tokens=True), self.tok.model.end_of_word_suffix
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for s, i in vocab.items() if s.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _other(self, piece: str) -> bytes:
        """A piece that only the library's own steps take apart."""
        if any(s in piece for s in self.special):
            return np.asarray(self.tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        merge, out = self.tok.model.tokenize, []
        for form, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(piece)):
            out.append(self.by_form.get(form) or np.asarray([t.id for t in merge(form)], "<u4").tobytes())
        return b"".join(out)

    def _merge(self, pre_tokens: list[str]) -> None:
        """Merges of unproven pre-tokens, all at once."""
        for at in range(0, len(pre_tokens), 20_000):
            part = pre_tokens[at : at + 20_000]
            forms = " ".join(p if p.isascii() else p.translate(self.forms) for p in part)
            ids = np.asarray(self.merges.encode_batch_fast([forms], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.is_end[ids]) + 1)
            if len(ends) != len(part):
                raise ValueError("a pre-token was cut again")
            start, data = 0, ids.tobytes()
            for p, end in zip(part, ends.tolist()):
                self.known[p] = data[start:end]
                start = end

    def _learn(self, new: set[str]) -> None:
        """Ids of pre-tokens, and of pieces marked by a space, that the store lacks."""
        proven, known, unknown = self.proven, self.known, []
        for p in new:
            if p in proven:
                known[p] = proven[p]
            elif p[0] == " ":
                known[p] = self._other(p[1:])
            else:
                unknown.append(p)
        self._merge(unknown)
        self.held += sum(map(len, new)) + sum(len(known[p]) for p in new)

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text that is not plain as a whole, and its other pieces, marked by a space."""
        out: list[str] = []
        for piece in _SPACE.split(text):
            if _PLAIN.fullmatch(piece) and not any(s in piece for s in self.special):
                out += _CUT.findall(piece.lower())
            else:
                out.append(" " + piece)
        return out

    def _cut(self, texts: list[str]) -> list[list[str]]:
        if len(self.known) > MEMO or self.held > HELD_BYTES:
            self.known, self.held = {}, 0
        cut = [_CUT.findall(t.lower()) if _TEXT.fullmatch(t) and not any(s in t for s in self.special) else self._pieces(t) for t in texts]
        if new := set().union(*cut).difference(self.known):
            self._learn(new)
        return cut

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        cut = self._cut(texts)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def count_many(self, texts: list[str]) -> list[int]:
        """The number of each text's ids."""
        cut = self._cut(texts)
        get = self.known.__getitem__
        return [sum(map(len, map(get, c))) // 4 for c in cut]

    def ids(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def count(self, text: str) -> int:
        return self.count_many([text])[0]


def text_groups(texts: list[str | None], size: int = 500_000):
    """Lists of texts (null: empty) of about ``size`` characters; a longer text is one of its own."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


_ENCODERS: dict[str, WholeTokenEncoder] = {}
store("tokens", _ENCODERS.clear)


def encoder(path: str, whole: dict[str, int]) -> WholeTokenEncoder:
    """One encoder for each worker process and vocabulary."""
    only("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = WholeTokenEncoder(path, whole)
    return _ENCODERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    Null and empty texts count no bytes and no tokens. Whole texts are read,
    however long. Repeated rows, null keys and ties are kept row by row; other
    columns are ignored; an empty table gives no rows. There is no shuffle, and
    a worker holds one Arrow batch, the proven table and the bounded store.
    """
    ready(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(path))  # at most the vocabulary

    def run(source):
        enc = encoder(path, whole.value)
        for b in source:
            n = np.asarray([c for group in text_groups(b.column(1).to_pylist()) for c in enc.count_many(group)], np.int64)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

