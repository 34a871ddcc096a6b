"""Secrets in text: three fixed patterns, and strings that a tokenizer cannot compress.

A vocabulary learned from text spends few tokens on words and many on random strings.
Runs of at least ``MIN_RUN`` characters ``[A-Za-z0-9+/_-]`` (with padding ``=``) whose
characters per token stay below ``MAX_RATIO`` are spans of kind ``random``, unless a
pattern span covers part of them or they are known to be harmless: digests (hex of a
usual digest length), UUIDs, numbers and dates, and identifiers made of words and short
numbers, whose words the tokenizer must know.  In the host and path of an address each
piece between slashes is a run of its own; what stands in front of an ``@``, or behind a
quote, a comma or a query separator, is a run like any other.  The only piece of a path,
right behind a host without credentials and with nothing after it, names the page and
is not tested.

Spans count code points, end exclusive.  Defined results: null and empty texts have no
spans; ids may be null or repeated (one row per row); extra columns are ignored by
``find_secrets`` and kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.words import _class, buffer_of, find_words, parts

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
#: Characters per token of random base64 are about 1.4, of random hex 1.7, of rare long words 2.2 and more.
MAX_RATIO = 2.0
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

# fixed values: the patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN)
_RUN_BYTES = _class((0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x39), (0x3D, 0x3D), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Host and path of an address: up to white space, a quote, a bracket, or what separates lists and queries.
_ADDRESS = re.compile(r"""(?:://|www\.)[^\s"'`<>(){}\[\]|\\,;?&=#]*""")
_LONE_PAGE = re.compile(r"://[A-Za-z0-9.-]+(:\d+)?/[^/]+")
_PIECE = re.compile(r"[A-Z]?[a-z]+([A-Z][a-z]+)*\d{0,4}|[A-Z]+\d{0,4}|\d{1,8}|")


@cache
def encoding(path: str):
    """The vocabulary of a .tiktoken file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _known(pieces: list[str], vocabulary: str) -> bool:
    """Whether the words among the pieces of an identifier (not numbers, not single letters) are words to the tokenizer."""
    words = [w if not w.isupper() else w.lower() for w in (p.rstrip("0123456789") for p in pieces) if len(w) > 1]
    return sum(map(len, words)) >= MAX_RATIO * sum(len(encoding(vocabulary).encode_ordinary(w)) for w in words)


def _harmless(run: str, vocabulary: str) -> bool:
    if _HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run):
        return True
    if re.fullmatch(r"[\d+/_-]+", run):
        return True
    pieces = re.split(r"[+/_-]", run)
    return len(pieces) > 1 and all(_PIECE.fullmatch(p) for p in pieces) and _known(pieces, vocabulary)


def looks_random(run: str, vocabulary: str) -> bool:
    """The token-efficiency test of one run."""
    body = run.rstrip("=")
    if len(body) < MIN_RUN or _harmless(body, vocabulary):
        return False
    if body.isalpha() and body.isupper():
        body = body.lower()  # shouted words are words
    return len(body) < MAX_RATIO * len(encoding(vocabulary).encode_ordinary(body))


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every run to test, in order: in addresses, of every piece between slashes that is long enough."""
    addresses = _ADDRESS.finditer(text) if "://" in text or "www." in text else iter(())
    address = next(addresses, None)
    for m in _RUN.finditer(text):
        a, b = m.span()
        while address and address.end() <= a:
            address = next(addresses, None)
        if not address or a < address.start():
            yield a, b
        elif text[b : b + 1] == "@":  # credentials
            a += len(text[a:b]) - len(text[a:b].lstrip("/"))
            if b - a >= MIN_RUN:
                yield a, b
        elif not (_LONE_PAGE.fullmatch(address[0]) and text[address.end() : address.end() + 1] not in ("?", "&", "=", "#", ";", "|")):
            while a < b:
                end = text.find("/", a, b)
                end = b if end < 0 else end
                if end - a >= MIN_RUN:
                    yield a, end
                a = end + 1


def spans_of(text: str, vocabulary: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span of one text, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if _has_keyword(text) else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    base = list(out)
    for a, b in _runs(text):
        if not any(s < b and a < e for s, _, e in base) and looks_random(text[a:b], vocabulary):
            out.append((a, 3, b))
    return sorted(out)


def _batch_spans(texts: pa.Array, vocabulary: str) -> Iterator[list[tuple[int, int, int]]]:
    """Spans of each text.  A text without a long run and without a keyword has none and is not searched."""
    for i, j in parts(texts):
        some = texts.slice(i, j - i)
        data, at = buffer_of(some)
        runs = find_words(data, at, _RUN_BYTES, hashed=False)
        long = np.zeros(j - i, bool)
        long[runs.doc[runs.end - runs.start >= MIN_RUN]] = True
        for row, text in enumerate(some.to_pylist()):
            if text and (long[row] or _has_keyword(text)):
                yield spans_of(text, vocabulary)
            else:
                yield []


def _has_keyword(text: str) -> bool:
    low = text.lower()
    return "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low


def _default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def find_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and spans (array of kind, start, end, in order) of every row."""
    vocabulary = vocabulary or _default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_batch_spans(batch.column("text"), vocabulary))
            flat = [s for f in found for s in f]
            struct = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())], ["kind", "start", "end"]
            )
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes), struct)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def listing(spans, *kinds: str):
    """Column: the spans of these kinds (all if none given) as kind:start:end, comma-joined."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, vocabulary: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (spans that overlap become one); all rows and columns stay."""
    vocabulary = vocabulary or _default_vocabulary()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for row, spans in enumerate(_batch_spans(batch.column("text"), vocabulary)):
                if spans:
                    out, done, text = [], 0, texts[row]
                    for a, _, b in spans:
                        if a >= done:
                            out += [text[done:a], mark]
                        done = max(done, b)
                    texts[row] = "".join([*out, text[done:]])
            at = names.index("text")
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
